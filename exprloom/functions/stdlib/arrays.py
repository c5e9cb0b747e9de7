"""Array transforms.  The input must be an array; functions of an item are optional where the language says so."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...errors import ExpressionTypeError
from ...operators import methods as m
from .. import dynamic
from .. import typed as t
from ..typed import Val

INT = T.IntegerType()


def items(name: str, v: Val) -> Val:
    if v.kind == "variant":
        return t.array_of(dynamic.as_array(v.col), T.VariantType())
    if v.kind != "array":
        raise ExpressionTypeError(name, "an array", v.label)
    return v


def function(name: str, args: tuple[Val, ...]) -> Val | None:
    if not args:
        return None
    if args[0].kind != "function":
        raise ExpressionTypeError(name, "a function such as .name or . > 1", args[0].label)
    return args[0]


def first(v: Val) -> Val:
    return t.of(F.get(v.col, F.lit(0)), t.element_type(v))


def last(v: Val) -> Val:
    return t.of(F.try_element_at(v.col, F.lit(-1)), t.element_type(v))


def unique(v: Val) -> Val:
    """Each value once, where it occurs first."""
    if not isinstance(t.element_type(v), T.VariantType):
        return t.of(F.array_distinct(v.col), v.type)
    names = F.transform(v.col, dynamic.identity)
    return t.of(F.filter(v.col, lambda x, k: F.array_position(names, F.get(names, k)) == k + 1), v.type)


def ordered(v: Val) -> Val:
    """Numbers by value, else texts by the root locale's collation; nulls last."""
    item = t.element_type(v)
    if t.kind_of(item) == "number":
        return t.of(F.array_sort(v.col), v.type)
    if t.kind_of(item) == "string":
        placed = F.array_sort(F.transform(v.col, lambda x: F.collate(x, "UNICODE")))
        return t.array_of(F.transform(placed, lambda x: F.collate(x, "UTF8_BINARY")), t.STRING)

    return t.of(m.placed_by(v.col, lambda x: F.collate(t.to_text(t.of(x, item)), "UNICODE")), v.type)


def _any(v: Val, fn: Val | None) -> Val:
    item = t.element_type(v)
    test = m._test(fn, item) if fn else lambda x: t.truthy(t.of(x, item))
    return t.of(F.exists(v.col, test), t.BOOLEAN)


def _all(v: Val, fn: Val | None) -> Val:
    item = t.element_type(v)
    test = m._test(fn, item) if fn else lambda x: t.truthy(t.of(x, item))
    return t.of(F.forall(v.col, test), t.BOOLEAN)


def _kept(v: Val, fn: Val | None) -> Val:
    item = t.element_type(v)
    return t.of(F.filter(v.col, m._test(fn, item) if fn else lambda x: t.truthy(t.of(x, item))), v.type)


def arrays(engine) -> None:
    plain = {
        "count": lambda v: t.of(F.when(v.col.isNotNull(), F.size(v.col)), INT),
        "first": first,
        "last": last,
        "reverse": m.reversed_array,
        "flatten": m.flat,
        "unique": unique,
        "sort": ordered,
    }
    for name, fn in plain.items():
        engine.add_transform(name, lambda v, *_, name=name, fn=fn: fn(items(name, v)), accepts=("array",))
    engine.add_transform("join", lambda v, s=None: m.join(items("join", v), None if s is None or s.kind == "null" else s), accepts=("array",))
    higher = {
        "filter": _kept,
        "map": lambda v, fn: m.map_array(v, fn) if fn else v,
        "find": lambda v, fn: m.find(v, fn) if fn else t.null(True),
        "some": _any,
        "every": _all,
    }
    for name, fn in higher.items():
        engine.add_transform(name, lambda v, *args, name=name, fn=fn: fn(items(name, v), function(name, args)), accepts=("array",))
