"""The standard library as plugins: ``engine.use(strings)`` and so on, or ``engine.use(everything)``."""

from __future__ import annotations

from .arrays import arrays
from .dates import dates
from .maths import maths
from .strings import strings
from .types import types

__all__ = ["arrays", "dates", "everything", "maths", "strings", "types"]


def everything(engine) -> None:
    for plugin in (strings, arrays, maths, types, dates):
        plugin(engine)
