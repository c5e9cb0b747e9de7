"""A small least-recently-used cache."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class Cache:
    """Holds up to ``size`` values; 0 or less holds none."""

    def __init__(self, size: int):
        self.size, self.held = size, OrderedDict()

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        if self.size <= 0:
            return make()
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        value = self.held[key] = make()
        if len(self.held) > self.size:
            self.held.popitem(last=False)
        return value

    def clear(self) -> None:
        self.held.clear()

    def __len__(self) -> int:
        return len(self.held)
