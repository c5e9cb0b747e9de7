"""What an expression may touch: checked on the syntax tree, before anything runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from .errors import SecurityError
from .syntax import nodes as n

# Names that are never accessible.
BLOCKED = frozenset({"__proto__", "constructor", "prototype"})


@dataclass(frozen=True)
class Options:
    """Limits and lists.  ``timeout`` is in milliseconds and 0 means none; it cancels the jobs of actions run through the
    engine.  ``strict`` makes null receivers and inputs fail while running instead of giving null.  ``missing`` says what
    a name that is no column means: "null" or "error"."""

    timeout: int = 0
    max_depth: int = 100
    max_array_length: int = 100_000
    allowed_properties: frozenset[str] | None = None
    denied_properties: frozenset[str] | None = None
    cache_size: int = 256
    strict: bool = False
    missing: str = "null"
    lambda_precedence: str = "reference"

    @staticmethod
    def of(**values) -> Options:
        for name in ("allowed_properties", "denied_properties"):
            if (given := values.get(name)) is not None:
                values[name] = frozenset(given)
        return Options(**values)


def is_index(name: str) -> bool:
    """A canonical array index, which lists of names don't cover."""
    return name.isascii() and name.isdigit() and len(name) <= 10 and (name == "0" or name[0] != "0")


class Policy:
    def __init__(self, options: Options):
        self.options = options

    def name(self, name: str, kind: str) -> None:
        """Check an access of ``kind`` identifier, object-key, member or method."""
        o = self.options
        if name in BLOCKED:
            raise SecurityError("BLOCKED_PROPERTY", f'Access to "{name}" is blocked')
        if kind not in ("member", "method") or is_index(name):
            return
        if o.allowed_properties is not None and name not in o.allowed_properties:
            raise SecurityError("PROPERTY_NOT_ALLOWED", f'Property "{name}" is not in the allowed list')
        if o.denied_properties is not None and name in o.denied_properties:
            raise SecurityError("PROPERTY_DENIED", f'Property "{name}" is denied')

    def length(self, size: int) -> None:
        if size > self.options.max_array_length:
            raise SecurityError("MAX_ARRAY_LENGTH", f"Array length {size} exceeds the limit of {self.options.max_array_length}")

    def depth(self, node: n.Node) -> None:
        """The nesting of compound nodes, over all branches."""
        if n.depth(node, self.options.max_depth) > self.options.max_depth:
            raise SecurityError("MAX_DEPTH", f"Expression depth exceeds the limit of {self.options.max_depth}")

    def describe(self) -> dict[str, Iterable[str] | None]:
        """The lists that are configured."""
        lists = {"allowed_properties": self.options.allowed_properties, "denied_properties": self.options.denied_properties}
        return {k: sorted(v) for k, v in lists.items() if v is not None}
