"""VARIANT values by the type they have at run time.

A JSON value keeps its kind: the text "5" is no number, the text "false" is true.  Every test here branches on the kind that
Spark reports for the value, so that dynamic values follow the same rules as columns of a static type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT_TEXT = "[object Object]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and stands in the plan once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named(name: Column, kind: str) -> Column:
    """Whether the name that Spark gives a value's type means that kind."""
    if kind in ("string", "boolean"):
        return name == kind.upper()
    if kind in ("array", "object"):
        return F.startswith(name, F.lit(kind.upper()))
    return ~(name.isin("STRING", "BOOLEAN", "VOID") | F.startswith(name, F.lit("ARRAY")) | F.startswith(name, F.lit("OBJECT")))


def kind(v: Column) -> Column:
    """string, number, boolean, array, object, or null, which SQL's null is too."""

    def named(name: Column) -> Column:
        out = F.when(name.isNull() | (name == "VOID"), F.lit("null"))
        for each in ("string", "boolean", "array", "object"):
            out = out.when(_named(name, each), F.lit(each))
        return out.otherwise(F.lit("number"))

    return let(F.schema_of_variant(v), named)


def is_kind(v: Column, name: str) -> Column:
    """Never null."""
    schema = F.schema_of_variant(v)
    return F.coalesce(let(schema, lambda x: _named(x, name)) if name == "number" else _named(schema, name), F.lit(False))


def missing(v: Column) -> Column:
    """Null of either sort."""
    return let(v, lambda v: v.isNull() | F.is_variant_null(v))


def _as(name: str, type_: str) -> Callable[[Column], Column]:
    return lambda v: let(v, lambda v: F.when(is_kind(v, name), F.try_variant_get(v, "$", type_)))


#: The value if it is of that kind, else null.
as_string, as_double, as_boolean, as_array = _as("string", "string"), _as("number", "double"), _as("boolean", "boolean"), _as("array", "array<variant>")


def by_kind(v: Column, cases: dict[str, Callable[[Column], Column]], other: Column | None = None) -> Column:
    """What the case for the value's kind makes of it; ``other`` where there is none."""

    def pick(pair: Column) -> Column:
        out = None
        for name, make in cases.items():
            test, value = _named(pair["name"], name), make(pair["value"])
            out = F.when(test, value) if out is None else out.when(test, value)
        return out if other is None else out.otherwise(other)

    return let(v, lambda v: let(F.struct(v.alias("value"), F.schema_of_variant(v).alias("name")), pick))


def identity(v: Column) -> Column:
    """A text that two values share if they are the same value: kind and content.  Numbers go by value; of null there is one."""
    number = lambda v: F.concat(F.lit("number:"), let(F.try_variant_get(v, "$", "double"), lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string"))))
    other = {name: lambda v, name=name: F.concat(F.lit(f"{name}:"), F.to_json(v)) for name in ("string", "boolean", "array", "object")}
    return by_kind(v, {"number": number, **other}, F.lit("null"))


def equal(a: Column, b: Column) -> Column:
    """Strict equality of two values, never null."""
    return F.coalesce(identity(a) == identity(b), F.lit(False))


def truthy(v: Column) -> Column:
    number = lambda v: let(F.try_variant_get(v, "$", "double"), lambda x: (x != 0) & ~F.isnan(x))
    yes = lambda v: F.lit(True)
    cases = {"number": number, "string": lambda v: F.try_variant_get(v, "$", "string") != "", "boolean": lambda v: F.try_variant_get(v, "$", "boolean"), "array": yes, "object": yes}
    return F.coalesce(by_kind(v, cases, F.lit(False)), F.lit(False))
