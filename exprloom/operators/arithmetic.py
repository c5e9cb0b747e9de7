"""Binary and unary operators, constructors' helpers and member access."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionTypeError
from ..functions import dynamic
from ..functions import typed as t
from ..functions.typed import Val


# Constants are computed here, because Spark's ANSI arithmetic raises where the language has Infinity or NaN.


def fold_binary(op: str, a: Any, b: Any) -> Any:
    """The result for two known operands, or ``UNKNOWN`` where it is left to Spark."""
    if op in ("==", "!="):
        same = (isinstance(a, bool) == isinstance(b, bool)) and type(a) is type(b) and a == b
        return same if op == "==" else not same
    if op == "+" and (isinstance(a, str) or isinstance(b, str)):
        return t._literal_text(a) + t._literal_text(b)
    if op in ("<", ">", "<=", ">="):
        if not (isinstance(a, str) and isinstance(b, str)):
            a, b = as_float(a), as_float(b)
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if op not in ("+", "-", "*", "/", "%", "**"):
        return t.UNKNOWN
    return arithmetic(op, as_float(a), as_float(b))


def as_float(x: Any) -> float:
    return t.python_number(x) if isinstance(x, str) else float(x)


def arithmetic(op: str, a: float, b: float) -> float:
    try:
        if op == "+":
            return a + b
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op == "/":
            if b == 0:
                return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
            return a / b
        if op == "%":
            return math.nan if b == 0 or math.isinf(a) else math.fmod(a, b)
        if math.isnan(b) or (abs(a) == 1 and math.isinf(b)):
            return math.nan
        result = a**b
        return math.nan if isinstance(result, complex) else result
    except ZeroDivisionError:
        return math.inf
    except OverflowError:
        return -math.inf if a < 0 and b % 2 == 1 else math.inf
    except ValueError:
        return math.nan


def binary(op: str, a: Val, b: Val) -> Val:
    """Arithmetic, comparison and equality."""
    for v in (a, b):
        if v.kind == "function":
            raise ExpressionTypeError(op, "a value", "function")
    if a.known and b.known and not (a.kind == "null" or b.kind == "null"):
        folded = fold_binary(op, a.const, b.const)
        if folded is not t.UNKNOWN:
            return t.constant(folded)
    if op in ("==", "!="):
        return equal(a, b, op == "!=")
    if op in ("<", ">", "<=", ">="):
        return compare(op, a, b)
    if op == "+" and ({a.kind, b.kind} & {"string", "array", "object"}):
        return t.of(F.concat(t.to_text(a), t.to_text(b)), t.STRING)
    if op == "+" and "variant" in (a.kind, b.kind):
        return _dynamic_sum(a, b)
    for v in (a, b):
        if v.kind == "object":
            raise ExpressionTypeError(op, "numbers", v.label)
    x, y = t.to_number(a), t.to_number(b)
    if op == "+":
        return t.of(x + y, t.DOUBLE)
    if op == "-":
        return t.of(x - y, t.DOUBLE)
    if op == "*":
        return t.of(x * y, t.DOUBLE)
    if op == "**":
        return t.of(F.pow(x, y), t.DOUBLE)
    safe = b.known and isinstance(b.const, float) and b.const != 0
    if op == "%":
        plain = x % y
        return t.of(plain if safe else F.when(y == 0, F.when(x.isNotNull(), F.lit(math.nan))).otherwise(x % y), t.DOUBLE)
    endless = F.when((x == 0) | F.isnan(x), F.lit(math.nan)).when(x > 0, F.lit(math.inf)).when(x < 0, F.lit(-math.inf))
    return t.of(x / y if safe else F.when(y == 0, endless).otherwise(x / y), t.DOUBLE)


def _dynamic_sum(a: Val, b: Val) -> Val:
    """Text is joined, other values are added: which of the two is known at run time only."""

    def body(pair: Column) -> Column:
        x, y = (v if v.known else t.of(pair[k], v.type) for k, v in (("x", a), ("y", b)))
        texts = [dynamic.kind(v.col).isin("string", "array", "object") for v in (x, y) if v.kind == "variant"]
        joined = F.concat(t.to_text(x), t.to_text(y)).cast("variant")
        added = (t.to_number(x) + t.to_number(y)).cast("variant")
        return F.when(texts[0] if len(texts) == 1 else texts[0] | texts[1], joined).otherwise(added)

    return t.of(dynamic.let(F.struct(a.col.alias("x"), b.col.alias("y")), body), T.VariantType())


def comparable(a: Val, b: Val) -> tuple[Column, Column]:
    """Two numbers in a type that keeps a comparison with a column bare, so that scans can apply it."""
    for v, w in ((a, b), (b, a)):
        if isinstance(v.type, t.INTEGRAL) and w.known and isinstance(w.const, float) and w.const.is_integer() and abs(w.const) < 2**31:
            literal = F.lit(int(w.const))
            return (v.col, literal) if v is a else (literal, v.col)
    if isinstance(a.type, t.INTEGRAL) and isinstance(b.type, t.INTEGRAL):
        return a.col, b.col
    if type(a.type) is type(b.type) and isinstance(a.type, t.TEMPORAL):
        return a.col, b.col
    return t.to_number(a), t.to_number(b)


def compare(op: str, a: Val, b: Val) -> Val:
    """A relation; null is compared like NaN, with nothing true, unless it is a literal null, which is 0."""
    if any(v.kind == "null" and v.absent for v in (a, b)):
        return t.boolean(False)
    texts = None
    if {a.kind, b.kind} <= {"string", "variant"} and "variant" in (a.kind, b.kind):
        x, y = (dynamic.as_string(v.col) if v.kind == "variant" else v.col for v in (a, b))
        texts = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    if a.kind == "string" and b.kind == "string":
        x, y, guards = a.col, b.col, []
    else:
        for v in (a, b):
            if v.kind in ("object", "array"):
                raise ExpressionTypeError(op, "numbers or strings", v.label)
        x, y = comparable(a, b)
        # Spark holds NaN greater than all; only the side on which that would make a relation true needs a guard.
        above = [(a, x)] if op in (">", ">=") else [(b, y)]
        if op in ("<=", ">="):
            above = [(a, x), (b, y)]
        guards = [~F.isnan(c) for v, c in above if not t.finite_type(v) or v.kind in ("string", "variant")]
    result = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    for guard in guards:
        result = result & guard
    return t.of(result if texts is None else F.coalesce(texts, result), t.BOOLEAN)


def equal(a: Val, b: Val, negate: bool) -> Val:
    """Strict equality: values of different kinds differ.  Null equals null; NaN equals nothing; arrays and objects are
    compared by value."""
    if a.kind == "null" and b.kind == "null":
        return t.boolean((a.absent == b.absent) != negate)
    if a.kind == "null" or b.kind == "null":
        other = b if a.kind == "null" else a
        missing = dynamic.missing(other.col) if other.kind == "variant" else other.col.isNull()
        return t.of(~missing if negate else missing, t.BOOLEAN)
    if "variant" in (a.kind, b.kind):
        same = _dynamic_equal(a, b)
        return t.of(~same if negate else same, t.BOOLEAN)
    if a.kind != b.kind:
        both_null = a.col.isNull() & b.col.isNull() if not (a.known or b.known) else F.lit(False)
        return t.of(~both_null if negate else both_null, t.BOOLEAN) if not (a.known or b.known) else t.boolean(negate)
    if a.kind == "number":
        x, y = comparable(a, b)
        guards = [~F.isnan(c) for v, c in ((a, x), (b, y)) if not t.finite_type(v)]
        if a.known or b.known:
            guards = []  # a literal that is no NaN can't equal one
    else:
        x, y = a.col, b.col
        guards = []
        if a.kind == "array" and a.type != b.type:
            (x, y), _ = t.unify([a, b])
        if a.kind == "object" and a.type != b.type:
            return t.boolean(negate)
    same = x.eqNullSafe(y)
    for guard in guards:
        same = same & F.coalesce(guard, F.lit(True))
    return t.of(~same if negate else same, t.BOOLEAN)


def _dynamic_equal(a: Val, b: Val) -> Column:
    """Whether a dynamic value is the same, in kind and content, as another or as a value of a static type."""
    if a.kind != "variant":
        a, b = b, a
    as_kind = {"string": dynamic.as_string, "number": dynamic.as_double, "boolean": dynamic.as_boolean}.get(b.kind)
    if as_kind is None:
        return dynamic.equal(a.col, t.cast_to(b, T.VariantType()))
    x, y = as_kind(a.col), t.as_double(b) if b.kind == "number" else b.col
    same = x == y
    if b.kind == "number" and not t.finite_type(b):
        same = same & ~F.isnan(y)
    same = F.coalesce(same, F.lit(False))
    return same if b.known else same | (dynamic.missing(a.col) & b.col.isNull())


def contains(needle: Val, pool: Val, negate: bool, literal: list[Val] | None) -> Val:
    """``in`` and ``not in``: a part of a string or an element of an array."""
    if pool.kind == "string":
        found = F.contains(pool.col, t.to_text(needle))
        found = F.coalesce(found, F.lit(False)) if negate else found
    elif literal is not None and literal and all(v.known and v.kind == needle.kind for v in literal) and needle.kind in ("string", "number") and not any(v.const != v.const for v in literal):
        column, values = needle.col, [v.const for v in literal]
        if isinstance(needle.type, t.INTEGRAL) and all(x.is_integer() for x in values):
            values = [int(x) for x in values]
        elif needle.kind == "number":
            column = t.as_double(needle)
        found = column.isin(*values)
        found = F.coalesce(found, F.lit(False)) if negate else found
    elif pool.kind == "array":
        found = array_has(pool, needle)
    elif pool.kind == "variant":
        inside = F.contains(dynamic.as_string(pool.col), t.to_text(needle))
        found = F.coalesce(inside, array_has(t.array_of(dynamic.as_array(pool.col), T.VariantType()), needle))
    else:
        raise ExpressionTypeError("in", "a string or array", pool.label)
    return t.of(~found if negate else found, t.BOOLEAN)


def array_has(array: Val, needle: Val) -> Column:
    """Whether an element is the same value; NaN is found, null too."""
    item = t.element_type(array)
    if t.common_type([item, needle.type]) is None and not isinstance(item, T.VariantType) and needle.kind != "variant":
        return F.lit(False)
    if needle.kind == "null":
        test = dynamic.missing if isinstance(item, T.VariantType) else lambda x: x.isNull()
    elif needle.kind == "number" and isinstance(item, (*t.INTEGRAL, *t.FLOATING, T.DecimalType)):
        want = t.as_double(needle)
        test = lambda x: x.cast("double").eqNullSafe(want)
    else:
        test = lambda x: equal(t.of(x, item), needle, False).col
    return F.coalesce(F.exists(array.col, test), F.lit(False))


def negative(v: Val) -> Val:
    if v.known and v.kind != "null":
        return t.number(-as_float(v.const))
    return t.of(-t.to_number(v), t.DOUBLE)


def positive(v: Val) -> Val:
    if v.known:
        return t.number(math.nan if v.absent else 0.0 if v.const is None else as_float(v.const))
    return t.of(t.to_number(v), t.DOUBLE)


def inverse(v: Val) -> Val:
    if v.known:
        return t.boolean(not (bool(v.const) and v.const == v.const))
    return t.of(~t.truthy(v), t.BOOLEAN)


def choose(test: Column, yes: Val, no: Val) -> Val:
    """``yes`` where ``test`` holds, else ``no``; branches of different types become VARIANT."""
    if yes.kind == "null" and no.kind == "null":
        return yes
    (x, y), type_ = t.unify([yes, no])
    return t.of(F.when(test, x).otherwise(y), type_)


def coalesce(a: Val, b: Val) -> Val:
    if a.kind == "null":
        return b
    if a.known:
        return a
    if b.kind == "null":
        return a
    (x, y), type_ = t.unify([a, b])
    return t.of(F.coalesce(x, y), type_)


def member(v: Val, name: str) -> Val:
    """A property by name: null-safe; a name that is not there is undefined."""
    kind = v.kind
    if kind == "string" and name == "length":
        return t.of(F.length(v.col), T.IntegerType())
    if kind == "array" and name == "length":
        return t.of(F.size(v.col), T.IntegerType()) if v.col is not None else t.null(True)
    if kind in ("string", "array") and name.isdigit():
        return element(v, t.number(int(name)))
    if isinstance(v.type, T.StructType):
        found = next((f for f in v.type.fields if f.name == name), None)
        return t.null(True) if found is None else t.of(v.col.getField(name), found.dataType)
    if isinstance(v.type, T.MapType):
        return t.of(F.try_element_at(v.col, F.lit(name).cast(v.type.keyType)), v.type.valueType)
    if kind == "variant":
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        if name == "length":
            cases = {"string": lambda v: F.length(F.try_variant_get(v, "$", "string")), "array": lambda v: F.size(F.try_variant_get(v, "$", "array<variant>")), "object": lambda v: F.try_variant_get(v, "$['length']", "int")}
            return t.of(dynamic.by_kind(v.col, cases), T.IntegerType())
        return t.of(F.try_variant_get(v.col, f"$['{quoted}']", "variant"), T.VariantType())
    if kind == "function":
        raise ExpressionTypeError(name, "a value", "function")
    return t.null(True)


def element(v: Val, key: Val) -> Val:
    """A computed property: an index of an array or a string, or a name."""
    if key.known and v.kind not in ("array", "string", "variant"):
        return member(v, t._literal_text(key.const) if key.const is not None else key.label)
    if key.known and isinstance(key.const, str) and not key.const.isdigit():
        return member(v, key.const)
    if isinstance(v.type, T.MapType):
        name = t.to_text(key) if t.kind_of(v.type.keyType) == "string" else key.col.cast(v.type.keyType)
        return t.of(F.try_element_at(v.col, name), v.type.valueType)
    if v.kind == "null":
        return t.null(True)
    at = t.to_number(key)
    index = F.when((at == F.floor(at)) & (at >= 0), at.cast("int"))
    if key.known and isinstance(key.const, float):
        index = F.lit(int(key.const)) if key.const.is_integer() and 0 <= key.const < 2**31 else F.lit(None).cast("int")
    if v.kind == "array":
        return t.of(F.get(v.col, index), t.element_type(v))
    if v.kind == "string":
        return t.of(F.nullif(F.substring(v.col, index + 1, F.lit(1)), F.lit("")), t.STRING)
    if v.kind == "variant" and key.known:
        return t.of(F.try_variant_get(v.col, f"$[{int(as_float(key.const))}]", "variant"), T.VariantType())
    raise ExpressionTypeError("[]", "a name that is known when compiling", "a computed key")
