"""Type tests and conversions."""

from __future__ import annotations

from .. import dynamic
from .. import typed as t
from ..typed import Val


def _is(kind: str):
    def run(v: Val, *_: Val) -> Val:
        if v.kind == "variant":
            return t.of(dynamic.is_kind(v.col, kind), t.BOOLEAN)
        return t.of(v.col.isNotNull(), t.BOOLEAN) if v.kind == kind else t.boolean(False)

    return run


def is_null(v: Val, *_: Val) -> Val:
    if v.kind == "null":
        return t.boolean(not v.absent)
    return t.of(dynamic.missing(v.col) if v.kind == "variant" else v.col.isNull(), t.BOOLEAN)


def types(engine) -> None:
    engine.add_transform("isString", _is("string"))
    engine.add_transform("isNumber", _is("number"))
    engine.add_transform("isArray", _is("array"))
    engine.add_transform("isNull", is_null)
    engine.add_transform("toBool", lambda v, *_: t.of(t.truthy(v), t.BOOLEAN))
    engine.add_transform("toNumber", lambda v, *_: t.of(t.to_number(v), t.DOUBLE))
    engine.add_transform("toString", lambda v, *_: t.of(t.to_text(v), t.STRING))
