"""Native methods on strings, arrays and numbers: a closed table by receiver kind.

Positions count code points.  Null receivers give null, or fail in strict mode."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionTypeError, SecurityError
from ..functions import dynamic
from ..functions import typed as t
from ..functions.typed import Val
from . import arithmetic as ops

INT, MOST_REPEATS = T.IntegerType(), 100_000
STRINGS: dict[str, Callable] = {}
ARRAYS: dict[str, Callable] = {}
NUMBERS: dict[str, Callable] = {}
TABLES = {"string": STRINGS, "array": ARRAYS, "number": NUMBERS}
#: Methods that take a function of an item.
WITH_FUNCTION = {"filter", "map", "find", "findIndex", "some", "every", "flatMap"}
#: What a method gives, where that does not depend on its input.
RETURNS = {
    "string": {"startsWith": "boolean", "endsWith": "boolean", "includes": "boolean", "indexOf": "number", "lastIndexOf": "number", "charCodeAt": "number", "split": "array"},
    "array": {"includes": "boolean", "some": "boolean", "every": "boolean", "indexOf": "number", "lastIndexOf": "number", "findIndex": "number", "join": "string"},
    "number": {"toFixed": "string", "toString": "string"},
}


def method(table: dict[str, Callable], *names: str):
    def add(fn: Callable) -> Callable:
        for name in names:
            table[name] = fn
        return fn

    return add


def call(receiver: Val, name: str, args: list[Val], strict: bool = False) -> Val:
    """The method's result; a name outside the table is a security error, as is any receiver but string, array, number."""
    if receiver.kind == "null":
        if strict:
            raise ExpressionTypeError(name, "a string, array or number", receiver.label)
        return t.null(True)
    if receiver.kind == "variant":
        return _dynamic_call(receiver.col, name, args, strict)
    found = TABLES.get(receiver.kind, {}).get(name)
    if found is None:
        raise SecurityError("METHOD_NOT_ALLOWED", f'Method "{name}" is not allowed on {receiver.label}')
    for arg in args:
        if arg.kind == "function" and name not in WITH_FUNCTION:
            raise ExpressionTypeError(name, "a value as argument", "function")
        if arg.kind == "object" and receiver.kind == "string":
            raise ExpressionTypeError(name, "a string or number as argument", "object")
    if strict and not receiver.known:
        message = F.lit(f'"{name}" expects a {receiver.kind}, got null')
        receiver = t.of(F.when(receiver.col.isNull(), F.raise_error(message)).otherwise(receiver.col), receiver.type)
    try:
        return found(receiver, *args)
    except TypeError as e:
        raise ExpressionTypeError(name, "other arguments", str(e)) from None


def _dynamic_call(col: Column, name: str, args: list[Val], strict: bool) -> Val:
    """A method of a JSON value: of its text, array or number, whichever of those has the method and the value is."""
    views = {"string": t.of(dynamic.as_string(col), t.STRING), "array": t.array_of(dynamic.as_array(col), T.VariantType()), "number": t.of(dynamic.as_double(col), t.DOUBLE)}
    views = {kind: view for kind, view in views.items() if name in TABLES[kind]}
    if not views:
        raise SecurityError("METHOD_NOT_ALLOWED", f'Method "{name}" is not allowed on a value')
    if strict:
        right = dynamic.kind(col).isin(*views)
        message = F.lit(f'"{name}" expects a value that is {" or ".join(views)}')
        col = F.when(right, col).otherwise(F.raise_error(message))
        views = {kind: t.of({"string": dynamic.as_string, "array": dynamic.as_array, "number": dynamic.as_double}[kind](col), view.type) for kind, view in views.items()}
    results = [(kind, call(view, name, args)) for kind, view in views.items()]
    out = results[-1][1]
    for kind, value in reversed(results[:-1]):
        out = ops.choose(dynamic.is_kind(col, kind), value, out)
    return out


def _int(v: Val | None, default: int | Column) -> Column:
    """An argument as a whole number, cut towards zero; NaN is 0."""
    if v is None or (v.kind == "null" and v.absent):
        return default if isinstance(default, Column) else F.lit(default)
    if v.known:
        x = 0.0 if v.const is None else ops.as_float(v.const)
        x = 0.0 if math.isnan(x) else max(-(2.0**31), min(2.0**31 - 1, x))
        return F.lit(int(x))
    if isinstance(v.type, t.INTEGRAL):
        return v.col.cast("int")
    x = t.to_number(v)
    x = F.when(F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(-(2.0**31)), F.least(x, F.lit(2.0**31 - 1))))
    return x.cast("int")


def _text(v: Val | None, default: str = "undefined") -> Column:
    return F.lit(default) if v is None else t.to_text(v)


def _from_end(at: Column, size: Column) -> Column:
    """A position that may count from the end, held inside."""
    return F.when(at < 0, F.greatest(at + size, F.lit(0))).otherwise(F.least(at, size))


def _cut(col: Column, first: Column, last: Column) -> Column:
    return F.substring(col, first + 1, F.greatest(last - first, F.lit(0)))


def _str(col: Column) -> Val:
    return t.of(col, t.STRING)


def _bool(col: Column) -> Val:
    return t.of(col, t.BOOLEAN)


# Strings.


@method(STRINGS, "startsWith")
def starts_with(s: Val, x: Val, at: Val | None = None) -> Val:
    if at is None:
        return _bool(F.startswith(s.col, _text(x)))
    return _bool(F.startswith(_cut(s.col, _clamped(at, s.col), F.length(s.col)), _text(x)))


@method(STRINGS, "endsWith")
def ends_with(s: Val, x: Val, end: Val | None = None) -> Val:
    if end is None:
        return _bool(F.endswith(s.col, _text(x)))
    return _bool(F.endswith(F.substring(s.col, F.lit(1), _clamped(end, s.col)), _text(x)))


def _clamped(at: Val | None, col: Column, default: Column | int = 0) -> Column:
    return F.greatest(F.lit(0), F.least(_int(at, default), F.length(col)))


@method(STRINGS, "substring")
def substring(s: Val, a: Val | None = None, b: Val | None = None) -> Val:
    x, y = _clamped(a, s.col), _clamped(b, s.col, F.length(s.col))
    return _str(_cut(s.col, F.least(x, y), F.greatest(x, y)))


@method(STRINGS, "charAt")
def char_at(s: Val, at: Val | None = None) -> Val:
    index = _int(at, 0)
    return _str(F.when(index < 0, F.lit("")).otherwise(F.substring(s.col, index + 1, F.lit(1))))


@method(STRINGS, "charCodeAt")
def char_code_at(s: Val, at: Val | None = None) -> Val:
    index = _int(at, 0)
    char = F.substring(s.col, index + 1, F.lit(1))
    return t.of(F.when((index < 0) | (char == ""), F.lit(math.nan)).otherwise(F.ascii(char).cast("double")), t.DOUBLE)


@method(STRINGS, "repeat")
def repeat(s: Val, n: Val | None = None) -> Val:
    if n is None or n.known:
        count = 0.0 if n is None or n.const is None else ops.as_float(n.const)
        if not 0 <= count <= MOST_REPEATS:
            raise ExpressionTypeError("repeat", f"a count from 0 to {MOST_REPEATS}", str(count))
        return _str(F.repeat(s.col, F.lit(int(count))))
    count = _int(n, 0)
    wrong = F.raise_error(F.lit(f'"repeat" expects a count from 0 to {MOST_REPEATS}'))
    return _str(F.when((count < 0) | (count > MOST_REPEATS), wrong).otherwise(F.repeat(s.col, count)))


@method(STRINGS, "trim")
def trim(s: Val) -> Val:
    return _str(t.trim(s.col))


@method(STRINGS, "trimStart")
def trim_start(s: Val) -> Val:
    return _str(t.trim(s.col, right=False))


@method(STRINGS, "trimEnd")
def trim_end(s: Val) -> Val:
    return _str(t.trim(s.col, left=False))


@method(STRINGS, "toLowerCase")
def lower(s: Val) -> Val:
    return _str(F.lower(s.col))


@method(STRINGS, "toUpperCase")
def upper(s: Val) -> Val:
    return _str(F.upper(s.col))


def _expanded(new: Val, found: Column, before: Column, after: Column) -> Column:
    """The replacement with its patterns: two dollars, and dollar with ampersand, backtick or quote, stand for a dollar, the
    match, and what is before and after it.  Only a known replacement is searched for them."""
    if not new.known or "$" not in str(new.const):
        return t.to_text(new)
    parts, rest = [], t._literal_text(new.const)
    while (at := rest.find("$")) >= 0:
        code = rest[at + 1 : at + 2]
        value = {"$": F.lit("$"), "&": found, "`": before, "'": after}.get(code)
        parts += [F.lit(rest[:at]), F.lit("$") if value is None else value]
        rest = rest[at + 1 + (value is not None) :]
    return F.concat(*parts, F.lit(rest))


@method(STRINGS, "replace")
def replace(s: Val, old: Val, new: Val | None = None) -> Val:
    """Replaces the first occurrence."""
    want = _text(old)
    at = F.instr(s.col, want)
    before, after = F.substring(s.col, F.lit(1), at - 1), F.substring(s.col, at + F.length(want), F.length(s.col))
    put = _expanded(new, want, before, after) if new is not None else F.lit("undefined")
    return _str(F.when(at > 0, F.concat(before, put, after)).otherwise(s.col))


@method(STRINGS, "replaceAll")
def replace_all(s: Val, old: Val, new: Val | None = None) -> Val:
    want = _text(old)
    if new is not None and new.known and re.search(r"\$[`']", str(new.const)):
        return _str(_replaced_with_surroundings(s.col, want, new))
    put = F.lit("undefined") if new is None else _expanded(new, want, F.lit(""), F.lit(""))
    if old.known and old.const == "":
        chars = F.split(s.col, "")
        spread = F.concat(put, F.call_function("array_join", chars, put), put)
        return _str(F.when(s.col == "", put).otherwise(spread))
    return _str(F.replace(s.col, want, put))


def _replaced_with_surroundings(text: Column, want: Column, new: Val) -> Column:
    """Every occurrence replaced by a text that tells what is before or after it.

    The text is split at the occurrences; what stands before the k-th is the first k parts joined again."""
    whole = F.split(text, F.concat(F.lit("\\Q"), F.replace(want, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    letters = F.concat(F.array(F.lit("")), F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), F.array(F.lit("")))
    parts = F.when(want == "", F.when(text == "", F.array(F.lit(""), F.lit(""))).otherwise(letters)).otherwise(whole)
    joined = lambda some: F.call_function("array_join", some, want)

    def piece(part: Column, k: Column) -> Column:
        before, after = joined(F.slice(parts, F.lit(1), k + 1)), joined(F.slice(parts, k + 2, F.size(parts)))
        return F.concat(part, F.when(k < F.size(parts) - 1, _expanded(new, want, before, after)).otherwise(F.lit("")))

    return F.call_function("array_join", F.transform(parts, piece), F.lit(""))


@method(STRINGS, "padStart")
def pad_start(s: Val, n: Val, fill: Val | None = None) -> Val:
    return _pad(s, n, fill, F.lpad)


@method(STRINGS, "padEnd")
def pad_end(s: Val, n: Val, fill: Val | None = None) -> Val:
    return _pad(s, n, fill, F.rpad)


def _pad(s: Val, n: Val, fill: Val | None, pad: Callable) -> Val:
    width, text = _int(n, 0), _text(fill, " ") if fill is None or not fill.absent else F.lit(" ")
    return _str(F.when((F.length(s.col) < width) & (text != ""), pad(s.col, width, text)).otherwise(s.col))


@method(STRINGS, "split")
def split(s: Val, separator: Val | None = None, limit: Val | None = None) -> Val:
    if separator is None or separator.absent:
        parts = F.array(s.col)
    elif separator.known:
        text = t._literal_text(separator.const) if separator.const is not None else "null"
        if text:
            parts = F.split(s.col, "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
        else:
            parts = F.when(s.col == "", F.array().cast("array<string>")).otherwise(F.split(s.col, ""))
    else:
        pattern = F.concat(F.lit("\\Q"), F.replace(t.to_text(separator), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        parts = F.split(s.col, pattern, -1)
    if limit is not None and not limit.absent:
        most = _int(limit, 0)  # a negative one wraps around to more parts than there can be
        parts = F.when(most < 0, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(most, F.lit(0))))
    return t.array_of(F.when(s.col.isNotNull(), parts), t.STRING)


@method(STRINGS, "includes")
def includes(s: Val, x: Val, at: Val | None = None) -> Val:
    pool = s.col if at is None else _cut(s.col, _clamped(at, s.col), F.length(s.col))
    return _bool(F.contains(pool, _text(x)))


@method(STRINGS, "indexOf")
def index_of(s: Val, x: Val, at: Val | None = None) -> Val:
    if at is None:
        return t.of(F.instr(s.col, _text(x)) - 1, INT)
    start = _clamped(at, s.col)
    inside = F.instr(_cut(s.col, start, F.length(s.col)), _text(x))
    return t.of(F.when(inside > 0, inside + start - 1).otherwise(F.when(s.col.isNotNull(), F.lit(-1))), INT)


@method(STRINGS, "lastIndexOf")
def last_index_of(s: Val, x: Val) -> Val:
    want = _text(x)
    at = F.instr(F.reverse(s.col), F.reverse(want))
    return t.of(F.when(at > 0, F.length(s.col) - F.length(want) - at + 1).otherwise(F.when(s.col.isNotNull(), F.lit(-1))), INT)


@method(STRINGS, "slice")
def slice_string(s: Val, a: Val | None = None, b: Val | None = None) -> Val:
    size = F.length(s.col)
    return _str(_cut(s.col, _from_end(_int(a, 0), size), _from_end(_int(b, size), size)))


@method(STRINGS, "at")
def at_string(s: Val, at: Val | None = None) -> Val:
    index, size = _int(at, 0), F.length(s.col)
    index = F.when(index < 0, index + size).otherwise(index)
    return _str(F.when(index >= 0, F.nullif(F.substring(s.col, index + 1, F.lit(1)), F.lit(""))))


@method(STRINGS, "concat")
def concat_string(s: Val, *parts: Val) -> Val:
    return _str(F.concat(s.col, *[t.to_text(p) for p in parts]))


@method(STRINGS, "toString")
def same_string(s: Val) -> Val:
    return s


# Numbers.


@method(NUMBERS, "toFixed")
def to_fixed(x: Val, digits: Val | None = None) -> Val:
    """A fixed number of decimals.  Half a unit of the last one is decided on the binary value, as the language does."""
    if digits is not None and not digits.known:
        raise ExpressionTypeError("toFixed", "a number of digits that is known when compiling", digits.label)
    places = 0 if digits is None or digits.const is None else int(ops.as_float(digits.const))
    if not 0 <= places <= 100:
        raise ExpressionTypeError("toFixed", "a number of digits from 0 to 100", str(places))
    value = t.as_double(x)
    shown = F.format_string(f"%.{places}f", value)
    if places < MOST_EXACT and not isinstance(x.type, t.INTEGRAL):
        shown = dynamic.let(value, lambda v: F.when(_below_tie(F.abs(v), places), F.format_string(f"%.{places}f", _cut_off(v, places))).otherwise(F.format_string(f"%.{places}f", v)))
    return _str(F.when(F.isnan(value) | (F.abs(value) >= 1e21), t.number_text(x)).otherwise(shown))


#: Powers of ten up to this one are exact in a double.
MOST_EXACT = 22


def _below_tie(v: Column, places: int) -> Column:
    """Whether a positive number prints like half a unit of its last place, but is less: formatting rounds the decimal text up.

    The product with a power of ten is taken with its rounding error, by splitting both factors in halves."""
    power = 10.0 ** (places + 1)
    high = 134217729.0 * power
    a, b = high - (high - power), power - (high - (high - power))
    scaled = v * power
    units = F.rint(scaled)
    part = lambda v: 134217729.0 * v - (134217729.0 * v - v)
    error = dynamic.let(v, lambda v: ((part(v) * a - v * power) + part(v) * b + (v - part(v)) * a) + (v - part(v)) * b)
    return (v < 2.0**53 / power) & (units % 10 == 5) & (units / power == v) & ((scaled - units) + error < 0)


def _cut_off(v: Column, places: int) -> Column:
    """A number without the decimals behind ``places``."""
    power = 10.0**places
    cut = (F.floor(F.rint(F.abs(v) * (power * 10)) / 10)).cast("double") / power
    return F.when(v < 0, -cut).otherwise(cut)


@method(NUMBERS, "toString")
def number_string(x: Val, radix: Val | None = None) -> Val:
    if radix is None or radix.absent:
        return _str(t.to_text(x))
    if not radix.known or not 2 <= ops.as_float(radix.const) <= 36:
        raise ExpressionTypeError("toString", "a radix from 2 to 36", radix.label)
    base, value = int(ops.as_float(radix.const)), t.as_double(x)
    if base == 10:
        return _str(t.to_text(x))
    return _str(dynamic.let(value, lambda v: _in_radix(v, base)))


def _in_radix(v: Column, base: int) -> Column:
    """A double's digits in a radix.  Fractions end only where the radix is a power of two; in others they are refused."""
    sign, size = F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.abs(v)
    digits = lambda x: F.lower(F.conv(x.cast("long").cast("string"), 10, base))
    whole = F.concat(sign, digits(F.floor(size)))
    wrong = F.raise_error(F.lit(f'"toString" in radix {base} expects a whole number')).cast("string")
    fraction = wrong
    if base & (base - 1) == 0:
        bits = base.bit_length() - 1
        places = 55 // bits
        scaled = (size - F.floor(size)) * 2.0 ** (places * bits)  # exact: a power of two
        shown = F.concat(whole, F.lit("."), F.regexp_replace(F.lpad(digits(scaled), places, "0"), "0+$", ""))
        fraction = F.when(scaled == F.floor(scaled), shown).otherwise(wrong)
    special = F.when(F.isnan(v), F.lit("NaN")).when(size == math.inf, F.concat(sign, F.lit("Infinity")))
    return special.when(v == F.floor(v), whole).otherwise(fraction)


# Arrays.


def _test(fn: Val, item: T.DataType) -> Callable[[Column], Column]:
    if fn.fn is None:
        raise ExpressionTypeError("array method", "a function such as .name or . > 1", fn.label)
    return lambda x: t.truthy(fn.fn(t.of(x, item)))


def mapped(a: Val, fn: Val) -> tuple[Column, T.DataType]:
    """The array of results and their type, which is found on the first column the function is built for."""
    if fn.fn is None:
        raise ExpressionTypeError("map", "a function such as .name or . > 1", fn.label)
    seen: list[T.DataType] = []

    def build(x: Column) -> Column:
        out = fn.fn(t.of(x, t.element_type(a)))
        seen.append(out.type)
        return out.col

    return F.transform(a.col, build), seen[-1]


@method(ARRAYS, "filter")
def filter_array(a: Val, fn: Val) -> Val:
    return t.of(F.filter(a.col, _test(fn, t.element_type(a))), a.type)


@method(ARRAYS, "map")
def map_array(a: Val, fn: Val) -> Val:
    return t.array_of(*mapped(a, fn))


@method(ARRAYS, "find")
def find(a: Val, fn: Val) -> Val:
    return t.of(F.get(F.filter(a.col, _test(fn, t.element_type(a))), F.lit(0)), t.element_type(a))


@method(ARRAYS, "findIndex")
def find_index(a: Val, fn: Val) -> Val:
    return t.of((F.array_position(F.transform(a.col, _test(fn, t.element_type(a))), True) - 1).cast("int"), INT)


@method(ARRAYS, "some")
def some(a: Val, fn: Val) -> Val:
    return _bool(F.exists(a.col, _test(fn, t.element_type(a))))


@method(ARRAYS, "every")
def every(a: Val, fn: Val) -> Val:
    return _bool(F.forall(a.col, _test(fn, t.element_type(a))))


def _flat(col: Column, item: T.DataType) -> Val:
    """One level less; a null among the inner arrays is kept as an element."""
    inner = item.elementType
    return t.array_of(F.flatten(F.transform(col, lambda x: F.coalesce(x, F.array(F.lit(None).cast(inner))))), inner)


@method(ARRAYS, "flatMap")
def flat_map(a: Val, fn: Val) -> Val:
    col, type_ = mapped(a, fn)
    return _flat(col, type_) if isinstance(type_, T.ArrayType) else t.array_of(col, type_)


@method(ARRAYS, "flat")
def flat(a: Val, depth: Val | None = None) -> Val:
    if depth is not None and not depth.known:
        raise ExpressionTypeError("flat", "a depth that is known when compiling", depth.label)
    times = 1 if depth is None or depth.const is None else ops.as_float(depth.const)
    while times >= 1 and isinstance(t.element_type(a), T.ArrayType):
        a, times = _flat(a.col, t.element_type(a)), times - 1
    return a


@method(ARRAYS, "join")
def join(a: Val, separator: Val | None = None) -> Val:
    return _str(t.join(a, F.lit(",") if separator is None or separator.absent else t.to_text(separator)))


@method(ARRAYS, "includes")
def array_includes(a: Val, x: Val | None = None) -> Val:
    return _bool(F.when(a.col.isNotNull(), ops.array_has(a, x or t.null(True))))


def _equal_flags(a: Val, x: Val) -> Column:
    item = t.element_type(a)
    return F.transform(a.col, lambda e: F.coalesce(ops.equal(t.of(e, item), x, False).col, F.lit(False)))


@method(ARRAYS, "indexOf")
def array_index_of(a: Val, x: Val) -> Val:
    return t.of((F.array_position(_equal_flags(a, x), True) - 1).cast("int"), INT)


@method(ARRAYS, "lastIndexOf")
def array_last_index_of(a: Val, x: Val) -> Val:
    at = F.array_position(F.reverse(_equal_flags(a, x)), True)
    return t.of(F.when(at > 0, F.size(a.col) - at).otherwise(at - 1).cast("int"), INT)


@method(ARRAYS, "slice")
def slice_array(a: Val, first: Val | None = None, last: Val | None = None) -> Val:
    size = F.size(a.col)
    x, y = _from_end(_int(first, 0), size), _from_end(_int(last, size), size)
    return t.of(F.slice(a.col, x + 1, F.greatest(y - x, F.lit(0))), a.type)


@method(ARRAYS, "at")
def at_array(a: Val, at: Val | None = None) -> Val:
    index = _int(at, 0)
    return t.of(F.get(a.col, F.when(index < 0, index + F.size(a.col)).otherwise(index)), t.element_type(a))


@method(ARRAYS, "concat")
def concat_array(a: Val, *parts: Val) -> Val:
    each = [a] + [p if p.kind == "array" else t.array_of(F.array(p.col), p.type) for p in parts]
    return concatenated(each)


def concatenated(arrays: list[Val]) -> Val:
    """Arrays one after another; elements that share no type become VARIANT."""
    item = t.common_type([t.element_type(a) for a in arrays])
    if item is None:
        item = T.VariantType()
        cols = [F.transform(a.col, lambda x, a=a: t.cast_to(t.of(x, t.element_type(a)), item)) for a in arrays]
    else:
        cols = [a.col if t.element_type(a) == item else a.col.cast(T.ArrayType(item)) for a in arrays]
    return t.array_of(F.concat(*cols) if len(cols) > 1 else cols[0], item)


@method(ARRAYS, "toReversed")
def reversed_array(a: Val) -> Val:
    return t.of(F.reverse(a.col), a.type)


@method(ARRAYS, "toSorted")
def sorted_array(a: Val, order: Val | None = None) -> Val:
    """By the elements' texts, nulls last."""
    if order is not None and not order.absent:
        raise ExpressionTypeError("toSorted", "no argument", order.label)
    item = t.element_type(a)
    return t.of(placed_by(a.col, lambda x: t.to_text(t.of(x, item))), a.type)


def placed_by(col: Column, key: Callable[[Column], Column]) -> Column:
    """The elements in the order of a key that is computed once for each; nulls last, ties as they were."""
    keyed = F.transform(col, lambda x, k: F.struct(x.isNull().alias("last"), key(x).alias("key"), k.alias("at")))
    return F.transform(F.array_sort(keyed), lambda s: F.get(col, s["at"]))


@method(ARRAYS, "toSpliced")
def spliced(a: Val, start: Val | None = None, count: Val | None = None, *items: Val) -> Val:
    if start is None:
        return a
    size = F.size(a.col)
    first = _from_end(_int(start, 0), size)
    gone = size - first if count is None else F.greatest(F.lit(0), F.least(_int(count, 0), size - first))
    head = t.of(F.slice(a.col, F.lit(1), first), a.type)
    tail = t.of(F.slice(a.col, first + gone + 1, F.greatest(size - first - gone, F.lit(0))), a.type)
    return concatenated([head, *[t.array_of(F.array(x.col), x.type) for x in items], tail])


@method(ARRAYS, "with")
def with_item(a: Val, at: Val, value: Val | None = None) -> Val:
    value = value or t.null(True)
    item = t.common_type([t.element_type(a), value.type])
    if item is None:
        item = T.VariantType()
    size, index = F.size(a.col), _int(at, 0)
    index = F.when(index < 0, index + size).otherwise(index)
    put, old = t.cast_to(value, item), t.element_type(a)
    changed = F.transform(a.col, lambda x, i: F.when(i == index, put).otherwise(t.cast_to(t.of(x, old), item)))
    wrong = F.raise_error(F.lit("Invalid index for with()"))
    return t.array_of(F.when((index < 0) | (index >= size), wrong).otherwise(changed), item)
