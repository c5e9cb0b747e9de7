"""String transforms.  The input must be a string; arguments are turned into text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...errors import ExpressionTypeError
from ...operators import methods as m
from .. import dynamic
from .. import typed as t
from ..typed import Val

MOST_PADDING = 100_000


def text(name: str, v: Val) -> Val:
    if v.kind == "variant":
        return t.of(dynamic.as_string(v.col), t.STRING)
    if v.kind != "string":
        raise ExpressionTypeError(name, "a string", v.label)
    return v


def _padded(name: str, pad):
    def run(v: Val, n: Val | None = None, fill: Val | None = None) -> Val:
        v = text(name, v)
        if n is None or n.kind not in ("number", "string", "boolean"):
            raise ExpressionTypeError(name, "a finite length", "undefined" if n is None else n.label)
        if n.known:
            width = t.python_number(n.const) if isinstance(n.const, str) else float(n.const)
            if not 0 <= width <= MOST_PADDING:
                raise ExpressionTypeError(name, f"a length from 0 to {MOST_PADDING}", t.python_number_text(width))
        else:
            width = t.to_number(n)
            wrong = F.raise_error(F.lit(f'"{name}" expects a length from 0 to {MOST_PADDING}'))
            n = t.of(F.when((width < 0) | (width > MOST_PADDING) | F.isnan(width), wrong).otherwise(width), t.DOUBLE)
        return pad(v, n, fill)

    return run


def strings(engine) -> None:
    plain = {"upper": m.upper, "lower": m.lower, "trim": m.trim}
    for name, fn in plain.items():
        engine.add_transform(name, lambda v, *_, name=name, fn=fn: fn(text(name, v)), accepts=("string",))
    needs = {"split": m.split, "replace": m.replace, "replaceAll": m.replace_all, "startsWith": m.starts_with, "endsWith": m.ends_with, "includes": m.includes}
    for name, fn in needs.items():

        def run(v: Val, *args: Val, name: str = name, fn=fn) -> Val:
            v = text(name, v)
            if name == "split" and (not args or args[0].kind == "null"):
                raise ExpressionTypeError(name, "a separator", "undefined" if not args else args[0].label)
            args = tuple(t.of(t.to_text(a), t.STRING) if not a.known or a.kind == "null" else t.string(t._literal_text(a.const)) for a in args) or (t.string("undefined"),)
            return fn(v, *args[: 2 if name.startswith("replace") else 1])

        engine.add_transform(name, run, accepts=("string",))
    engine.add_transform("padStart", _padded("padStart", m.pad_start), accepts=("string",))
    engine.add_transform("padEnd", _padded("padEnd", m.pad_end), accepts=("string",))
