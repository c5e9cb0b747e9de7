"""Errors with source positions, and name suggestions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Location:
    source: str
    start: int
    end: int


@dataclass(frozen=True)
class Position:
    """Line and column from 1, offset from 0."""

    line: int
    column: int
    offset: int


def position_at(source: str, offset: int) -> Position:
    offset = min(max(offset, 0), len(source))
    before = source[:offset]
    return Position(before.count("\n") + 1, offset - (before.rfind("\n") + 1) + 1, offset)


def format_error(message: str, location: Location, suggestion: str | None = None) -> str:
    """The message, the source line with carets under the span, and the position in words."""
    source = location.source
    start = min(max(location.start, 0), len(source))
    end = max(start + 1, min(max(location.end, 0), len(source)))
    at = position_at(source, start)
    line = source.split("\n")[at.line - 1]
    gutter = f"{at.line} | "
    carets = "^" * max(1, min(end - start, len(line) - at.column + 1))
    hint = f' Did you mean "{suggestion}"?' if suggestion else ""
    return f"{message}\n\n{gutter}{line}\n{' ' * (len(gutter) + at.column - 1)}{carets}{hint}\n\nat line {at.line}, column {at.column} (offset {start}-{end})"


class EngineError(Exception):
    """Base of all errors of the engine."""


class ExpressionError(EngineError):
    """The expression can't be parsed.  ``str()`` shows the place; ``raw_message`` is the bare message."""

    def __init__(self, message: str, source: str, start: int, end: int, suggestion: str | None = None):
        super().__init__(format_error(message, Location(source, start, end), suggestion))
        self.raw_message, self.source, self.start, self.end, self.suggestion = message, source, start, end, suggestion


class LocatedError(EngineError):
    """An error found while compiling; the innermost node that knows its place sets the location."""

    location: Location | None = None
    formatted: str | None = None

    def locate(self, source: str, start: int, end: int) -> None:
        if self.location is None:
            self.location = Location(source, start, end)
            self.formatted = format_error(str(self), self.location)


class ExpressionTypeError(LocatedError):
    """A value has the wrong type for an operation."""

    def __init__(self, name: str, expected: str, received: str):
        super().__init__(f'"{name}" expects {expected}, got {received}')
        self.name, self.expected, self.received = name, expected, received


class SecurityError(LocatedError):
    """The policy forbids it; ``code`` says which rule."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class ExpressionReferenceError(LocatedError):
    """An unknown transform or function."""

    def __init__(self, kind: str, name: str, suggestion: str | None = None):
        super().__init__(f'Unknown {kind} "{name}"' + (f'. Did you mean "{suggestion}"?' if suggestion else ""))
        self.kind, self.name, self.suggestion = kind, name, suggestion


def format_any(error: BaseException) -> str:
    """Any error as text, with its place in the source where that is known."""
    return getattr(error, "formatted", None) or str(error)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def suggest(name: str, known: Iterable[str], most: int = 2) -> str | None:
    """The first of the nearest known names within ``most`` edits; none for names of over 64 characters."""
    if len(name) > 64:
        return None
    ranked = [(edit_distance(name, k), n, k) for n, k in enumerate(known)]
    best = min(ranked, default=(most + 1, 0, ""))
    return best[2] if best[0] <= most else None
