"""Typed columns and the language's coercions as Spark expressions.

The language has one number type, no coercion in equality, and its own idea of truth; a Spark column has a
static type.  Every value here carries its type, so that each coercion is chosen while compiling and
the column stays a plain built-in expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionTypeError
from . import dynamic

UNKNOWN = object()
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
DOUBLE, STRING, BOOLEAN, VOID = T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()


@dataclass(frozen=True)
class Val:
    """A column with its type; ``const`` is its value where that is known; ``absent`` marks undefined as against null.

    ``fn`` makes it a function of an item instead, which only operations on arrays accept.  ``parts`` are the elements of an
    array that was written out, so that folds over it need no loop."""

    col: Column | None
    type: T.DataType
    const: Any = UNKNOWN
    absent: bool = False
    fn: Callable[[Val], Val] | None = None
    parts: tuple[Column, ...] | None = None

    @property
    def kind(self) -> str:
        if self.fn is not None:
            return "function"
        return kind_of(self.type)

    @property
    def known(self) -> bool:
        return self.const is not UNKNOWN

    @property
    def label(self) -> str:
        """The kind as error messages name it."""
        return "undefined" if self.absent and self.kind == "null" else self.kind


def kind_of(type_: T.DataType) -> str:
    if isinstance(type_, (*INTEGRAL, *FLOATING, T.DecimalType, *TEMPORAL)):
        return "number"
    if isinstance(type_, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(type_, T.BooleanType):
        return "boolean"
    if isinstance(type_, T.ArrayType):
        return "array"
    if isinstance(type_, T.NullType):
        return "null"
    if isinstance(type_, T.VariantType):
        return "variant"
    return "object"


def number(value: float) -> Val:
    value = float(value)
    return Val(F.lit(value), DOUBLE, value)


def string(value: str) -> Val:
    return Val(F.lit(value), STRING, value)


def boolean(value: bool) -> Val:
    return Val(F.lit(bool(value)), BOOLEAN, bool(value))


def null(absent: bool = False) -> Val:
    return Val(F.lit(None), VOID, None, absent)


def constant(value: Any) -> Val:
    if value is None:
        return null()
    if isinstance(value, bool):
        return boolean(value)
    return string(value) if isinstance(value, str) else number(value)


def of(col: Column, type_: T.DataType) -> Val:
    return Val(col, type_)


def as_double(v: Val) -> Column:
    """The number of a number; dates are milliseconds since the epoch."""
    if isinstance(v.type, TEMPORAL):
        return F.unix_millis(v.col.cast("timestamp")).cast("double")
    return v.col if isinstance(v.type, T.DoubleType) else v.col.cast("double")


def finite_type(v: Val) -> bool:
    """Whether a number can't be NaN."""
    if v.known and isinstance(v.const, float):
        return not math.isnan(v.const)
    return not isinstance(v.type, FLOATING)


def truthy(v: Val) -> Column:
    """The language's truth, never null."""
    if v.known:
        return F.lit(bool(v.const) and v.const == v.const)
    kind = v.kind
    if kind == "boolean":
        return F.coalesce(v.col, F.lit(False))
    if kind == "number":
        col = as_double(v)
        return v.col.isNotNull() & (col != 0) if finite_type(v) else v.col.isNotNull() & (col != 0) & ~F.isnan(col)
    if kind == "string":
        return v.col.isNotNull() & (v.col != "")
    if kind == "null":
        return F.lit(False)
    if kind == "variant":
        return dynamic.truthy(v.col)
    if kind == "function":
        return F.lit(True)
    return v.col.isNotNull()


def filter_condition(v: Val) -> Column:
    """Truth where null counts as false anyway: keeps a boolean column bare, so that it can be pushed into a scan."""
    return v.col if v.kind == "boolean" and not v.known else truthy(v)


def to_text(v: Val, missing: str | None = None) -> Column:
    """The value as text.  Null gives ``missing``, or the word for it."""
    word = missing if missing is not None else ("undefined" if v.absent else "null")
    if v.known and v.kind != "null":
        return F.lit(_literal_text(v.const))
    kind = v.kind
    if kind == "null":
        return F.lit(word)
    if kind == "string":
        text = v.col
    elif kind == "boolean":
        text = v.col.cast("string")
    elif kind == "variant":
        text = variant_text(v.col)
    elif kind == "number":
        text = number_text(v)
    elif kind == "array":
        text = join(v, F.lit(","))
    elif kind == "object":
        text = F.when(v.col.isNotNull(), F.lit(dynamic.OBJECT_TEXT))
    else:
        raise ExpressionTypeError("string conversion", "a value", v.label)
    return F.coalesce(text, F.lit(word))


def variant_text(v: Column, inner: bool = False) -> Column:
    """A dynamic value as text; null for null.  Arrays are joined by commas; those inside arrays print as JSON."""
    cases = {
        "string": lambda v: F.try_variant_get(v, "$", "string"),
        "number": lambda v: dynamic.let(F.try_variant_get(v, "$", "double"), lambda x: number_text(of(x, DOUBLE))),
        "boolean": lambda v: F.try_variant_get(v, "$", "string"),
        "object": lambda v: F.lit(dynamic.OBJECT_TEXT),
        "array": F.to_json if inner else lambda v: F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(variant_text(x, True), F.lit(""))), ","),
    }
    return dynamic.by_kind(v, cases)


def join(array: Val, separator: Column) -> Column:
    """Elements as text between separators; nulls are empty."""
    item = element_type(array)
    texts = F.transform(array.col, lambda x: to_text(of(x, item), ""))
    return F.call_function("array_join", texts, separator)


def _literal_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    return python_number_text(value)


def python_number_text(x: float) -> str:
    """A double as the language prints it."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x)) if abs(x) < 2**53 else _plain(repr(x))
    return _plain(repr(x))


def _plain(text: str) -> str:
    """Decimal digits of ``repr`` text, with an exponent only below 1e-6 and from 1e21 on."""
    sign, text = ("-", text[1:]) if text.startswith("-") else ("", text)
    mantissa, _, exponent = text.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits, point = whole + part, len(whole) + int(exponent or 0)
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    digits = stripped.rstrip("0") or "0"
    if -6 < point <= 21:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{digits}"
        if len(digits) <= point:
            return sign + digits + "0" * (point - len(digits))
        return f"{sign}{digits[:point]}.{digits[point:]}"
    power = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{'+' if power > 0 else '-'}{abs(power)}"


def number_text(v: Val) -> Column:
    """A number column as the language prints it: no trailing ``.0``, exponents only for very large and small values."""
    if isinstance(v.type, INTEGRAL):
        return v.col.cast("string")
    x = as_double(v)
    shown = x.cast("string")
    mantissa, power = F.regexp_extract(shown, r"^-?([0-9.]+)E", 1), F.regexp_extract(shown, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    wide = F.when(F.length(digits) > power + 1, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))).otherwise(F.rpad(digits, power + 1, "0"))
    tail = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(F.lit(""))
    science = F.concat(sign, F.substring(digits, F.lit(1), F.lit(1)), tail, F.when(power > 0, F.lit("e+")).otherwise(F.lit("e-")), F.abs(power).cast("string"))
    size = F.abs(x)
    return (
        F.when(F.isnan(x) | size.isin(float("inf")), shown)
        .when(x == 0, F.lit("0"))
        .when(~F.contains(shown, F.lit("E")), F.regexp_replace(shown, r"\.0$", ""))
        .when(size >= 1e21, science)
        .when(size < 1e-6, science)
        .when(size < 1, small)
        .otherwise(F.concat(sign, wide))
    )


_NUMERIC = r"^[ \t\n\r\x0B\f]*([+-]?(Infinity|[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+)[ \t\n\r\x0B\f]*$"


def python_number(text: str) -> float:
    """A text as a number, NaN where it is none."""
    import re

    text = text.strip(SPACES)
    if not text:
        return 0.0
    if not re.match(_NUMERIC, text):
        return math.nan
    if text[:2].lower() in ("0x", "0b", "0o"):
        return float(int(text, 0))
    return float(text)


def to_number(v: Val) -> Column:
    """The value as a double; null is NaN if absent, else 0 where it is known to be null, else null."""
    kind = v.kind
    if v.known:
        if kind == "null":
            return F.lit(math.nan if v.absent else 0.0)
        return F.lit(python_number(v.const) if kind == "string" else float(v.const))
    if kind == "number":
        return as_double(v)
    if kind == "boolean":
        return v.col.cast("double")
    if kind == "string":
        text = trim(v.col)
        radix = F.when(F.lower(F.substring(text, 1, 2)) == "0x", 16).when(F.lower(F.substring(text, 1, 2)) == "0b", 2).when(F.lower(F.substring(text, 1, 2)) == "0o", 8)
        other = F.coalesce(*[F.when(radix == r, F.conv(F.substring(text, F.lit(3), F.length(text)), r, 10).cast("double")) for r in (16, 2, 8)])
        return F.when(text.isNull(), None).when(text == "", F.lit(0.0)).when(~F.rlike(text, F.lit(_NUMERIC)), F.lit(math.nan)).when(radix.isNotNull(), other).otherwise(text.try_cast("double"))
    if kind == "variant":
        nan = lambda v: F.lit(math.nan)
        cases = {
            "number": lambda v: F.try_variant_get(v, "$", "double"),
            "string": lambda v: dynamic.let(F.try_variant_get(v, "$", "string"), lambda x: to_number(of(x, STRING))),
            "boolean": lambda v: F.try_variant_get(v, "$", "boolean").cast("double"),
        }
        return dynamic.by_kind(v.col, cases | {"array": nan, "object": nan})
    if kind == "null":
        return v.col.cast("double")
    raise ExpressionTypeError("number conversion", "a string, number or boolean", v.label)


#: White space that trimming removes.
SPACES = "\t\n\x0b\x0c\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"


def trim(col: Column, left: bool = True, right: bool = True) -> Column:
    """Without white space at the ends.  A text that begins and ends with printable ASCII is passed as it is: searching the set
    of all spaces costs more."""
    side = {(True, True): F.btrim, (True, False): F.ltrim, (False, True): F.rtrim}[left, right]
    ends = [F.ascii(col).between(33, 126)] * left + [F.ascii(F.substring(col, -1, 1)).between(33, 126)] * right
    return F.when(ends[0] if len(ends) == 1 else ends[0] & ends[1], col).otherwise(side(col, F.lit(SPACES)))


def element_type(array: Val) -> T.DataType:
    return array.type.elementType


def array_of(col: Column, item: T.DataType) -> Val:
    return Val(col, T.ArrayType(item, True))


def common_type(types: list[T.DataType]) -> T.DataType | None:
    """One type that holds all of ``types``, or none."""
    rest = [t for t in types if not isinstance(t, T.NullType)]
    if not rest:
        return VOID
    kinds = {kind_of(t) for t in rest}
    if len(kinds) > 1:
        return None
    if all(t == rest[0] for t in rest):
        return rest[0]
    if kinds == {"number"}:
        return DOUBLE
    if kinds == {"string"}:
        return STRING
    if kinds == {"array"}:
        inner = common_type([t.elementType for t in rest])
        return None if inner is None else T.ArrayType(inner, True)
    return None


def cast_to(v: Val, type_: T.DataType) -> Column:
    """The column as ``type_``, a type that :func:`common_type` found or VARIANT."""
    if v.type == type_:
        return v.col
    if isinstance(v.type, TEMPORAL) and kind_of(type_) == "number":
        return as_double(v)
    if isinstance(type_, T.VariantType):
        if v.kind == "null":
            return F.lit(None).cast("variant")
        return v.col.cast("variant")
    return v.col.cast(type_)


def unify(values: list[Val]) -> tuple[list[Column], T.DataType]:
    """Columns of one type; values that share none become VARIANT."""
    type_ = common_type([v.type for v in values])
    if type_ is None:
        if any(v.kind == "function" for v in values):
            raise ExpressionTypeError("value", "a value", "function")
        type_ = T.VariantType()
    return [cast_to(v, type_) for v in values], type_


def named(v: Val, col: Column) -> Val:
    return replace(v, col=col, const=UNKNOWN)
