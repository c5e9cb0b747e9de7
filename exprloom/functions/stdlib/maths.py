"""Number transforms, folds of number arrays, and the functions min and max."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...errors import ExpressionTypeError
from .. import dynamic
from .. import typed as t
from ..typed import Val


def digits(name: str, v: Val) -> Column:
    if v.kind == "variant":
        return dynamic.as_double(v.col)
    if v.kind != "number":
        raise ExpressionTypeError(name, "a number", v.label)
    return t.as_double(v)


def numbers(name: str, v: Val) -> Val:
    if v.kind == "variant":
        v = t.array_of(dynamic.as_array(v.col), T.VariantType())
    if v.kind == "array" and isinstance(t.element_type(v), T.VariantType):
        wrong = F.raise_error(F.lit(f'"{name}" expects an array of numbers')).cast("double")
        return t.array_of(F.transform(v.col, lambda x: F.when(dynamic.is_kind(x, "number"), dynamic.as_double(x)).otherwise(wrong)), t.DOUBLE)
    if v.kind != "array" or t.kind_of(t.element_type(v)) not in ("number", "null"):
        raise ExpressionTypeError(name, "an array of numbers", v.label if v.kind != "array" else f"array of {t.kind_of(t.element_type(v))}")
    item = t.element_type(v)
    if item == t.DOUBLE:
        return v
    if v.parts is not None:
        cols = tuple(t.cast_to(t.of(x, item), t.DOUBLE) for x in v.parts)
        return Val(F.array(*cols), T.ArrayType(t.DOUBLE, True), parts=cols)
    return t.array_of(F.transform(v.col, lambda x: t.cast_to(t.of(x, item), t.DOUBLE)), t.DOUBLE)


def rounded(x: Column) -> Column:
    """Half towards positive infinity."""
    low = F.floor(x).cast("double")
    near = F.when(x - low >= 0.5, low + 1).otherwise(low)
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(near)


def _whole(x: Column, fn) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(fn(x).cast("double"))


def total(v: Val) -> Column:
    if v.parts is not None:
        return sum(v.parts, F.lit(0.0))
    return F.aggregate(v.col, F.lit(0.0), lambda a, x: a + x)


def clamped(v: Val, low: Val, high: Val) -> Val:
    x, a, b = digits("clamp", v), digits("clamp", low), digits("clamp", high)
    held = F.least(F.greatest(x, a), b)
    return t.of(F.when(x.isNull() | a.isNull() | b.isNull(), None).when(F.isnan(x) | F.isnan(a) | F.isnan(b), F.lit(math.nan)).otherwise(held), t.DOUBLE)


def _extreme(pick, empty: float):
    def run(*args: Val) -> Val:
        if not args:
            return t.number(empty)
        if len(args) == 1 and args[0].kind == "array":  # a spread array column
            array = numbers(pick.__name__, args[0]).col
            ends = F.array_min(array) if pick is F.least else F.array_max(array)
            bad = F.exists(array, lambda x: x.isNull() | F.isnan(x))
            return t.of(F.when(F.size(array) == 0, F.lit(empty)).when(bad, F.lit(math.nan)).otherwise(ends), t.DOUBLE)
        cols = [t.to_number(a) for a in args]
        nan = cols[0].isNull() | F.isnan(cols[0])
        for c in cols[1:]:
            nan = nan | c.isNull() | F.isnan(c)
        return t.of(F.when(nan, F.lit(math.nan)).otherwise(pick(*cols) if len(cols) > 1 else cols[0]), t.DOUBLE)

    return run


def maths(engine) -> None:
    single = {"round": rounded, "floor": lambda x: _whole(x, F.floor), "ceil": lambda x: _whole(x, F.ceil), "abs": F.abs}
    for name, fn in single.items():
        engine.add_transform(name, lambda v, *_, name=name, fn=fn: t.of(fn(digits(name, v)), t.DOUBLE), accepts=("number",))
    engine.add_transform("sum", lambda v, *_: t.of(total(numbers("sum", v)), t.DOUBLE), accepts=("array",))

    def average(v: Val, *_: Val) -> Val:
        v = numbers("avg", v)
        return t.of(F.when(F.size(v.col) == 0, F.lit(0.0)).otherwise(total(v) / F.nullif(F.size(v.col), F.lit(0))), t.DOUBLE)

    engine.add_transform("avg", average, accepts=("array",))
    engine.add_transform("clamp", clamped, accepts=("number",))
    engine.add_function("min", _extreme(F.least, math.inf), spread=True)
    engine.add_function("max", _extreme(F.greatest, -math.inf), spread=True)
