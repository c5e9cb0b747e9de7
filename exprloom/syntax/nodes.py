"""The syntax tree.  Every node knows the span of source it came from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Node:
    start: int
    end: int

    @property
    def type(self) -> str:
        return type(self).__name__

    def children(self) -> Iterator[Node]:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, Node):
                yield value
            elif isinstance(value, tuple):
                yield from (x for x in value if isinstance(x, Node))


@dataclass(frozen=True)
class NumberLiteral(Node):
    value: float


@dataclass(frozen=True)
class StringLiteral(Node):
    value: str


@dataclass(frozen=True)
class BooleanLiteral(Node):
    value: bool


@dataclass(frozen=True)
class NullLiteral(Node):
    pass


@dataclass(frozen=True)
class UndefinedLiteral(Node):
    pass


@dataclass(frozen=True)
class Identifier(Node):
    name: str


@dataclass(frozen=True)
class BinaryExpression(Node):
    operator: str
    left: Node
    right: Node


@dataclass(frozen=True)
class UnaryExpression(Node):
    operator: str
    argument: Node


@dataclass(frozen=True)
class ConditionalExpression(Node):
    test: Node
    consequent: Node
    alternate: Node


@dataclass(frozen=True)
class MemberExpression(Node):
    object: Node
    property: Node
    computed: bool


@dataclass(frozen=True)
class OptionalMemberExpression(Node):
    object: Node
    property: Node
    computed: bool


@dataclass(frozen=True)
class ArrayLiteral(Node):
    elements: tuple[Node, ...]


@dataclass(frozen=True)
class ObjectProperty(Node):
    key: Node
    value: Node
    computed: bool
    shorthand: bool


@dataclass(frozen=True)
class ObjectLiteral(Node):
    properties: tuple[ObjectProperty, ...]


@dataclass(frozen=True)
class CallExpression(Node):
    callee: Node
    args: tuple[Node, ...]


@dataclass(frozen=True)
class PipeExpression(Node):
    input: Node
    transform: Node


@dataclass(frozen=True)
class TemplateLiteral(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class SpreadElement(Node):
    argument: Node


@dataclass(frozen=True)
class LambdaAccessor(Node):
    property: str


@dataclass(frozen=True)
class LambdaIdentity(Node):
    pass


@dataclass(frozen=True)
class LambdaExpression(Node):
    body: Node


LAMBDAS = (LambdaAccessor, LambdaIdentity, LambdaExpression)
ATOMS = (NumberLiteral, StringLiteral, BooleanLiteral, NullLiteral, UndefinedLiteral, Identifier, LambdaAccessor, LambdaIdentity)


def depth(node: Node, most: int) -> int:
    """The nesting of compound nodes over all branches, counted up to one more than ``most``."""
    level, here = 0, [node]
    while here and level <= most:
        compound = [x for x in here if not isinstance(x, ATOMS)]
        level += bool(compound)
        here = [c for x in compound for c in x.children()]
    return level


def same_tree(a: Node, b: Node) -> bool:
    """Whether two trees are equal, however deep."""
    rest = [(a, b)]
    while rest:
        x, y = rest.pop()
        if type(x) is not type(y):
            return False
        mine, other = list(x.children()), list(y.children())
        if len(mine) != len(other):
            return False
        for f in fields(x):
            v, w = getattr(x, f.name), getattr(y, f.name)
            if not isinstance(v, (Node, tuple)) and v != w and not (v != v and w != w):
                return False
        rest += zip(mine, other, strict=True)
    return True
