"""Dates as milliseconds since the epoch, in UTC; date and timestamp columns are taken as such."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...errors import ExpressionTypeError
from .. import typed as t
from ..typed import Val
from .maths import digits, rounded

# The fields of a format, each replaced where it occurs first.
FIELDS = ("YYYY", "MM", "DD", "HH", "mm", "ss")
DAY = 86_400_000


def _field(name: str, ms: Column) -> Column:
    days = F.floor(ms / DAY)
    date = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    rest = ms - days * DAY
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return {
        "YYYY": lambda: F.year(date).cast("string"),
        "MM": lambda: two(F.month(date)),
        "DD": lambda: two(F.dayofmonth(date)),
        "HH": lambda: two(F.floor(rest / 3_600_000)),
        "mm": lambda: two(F.floor(rest / 60_000) % 60),
        "ss": lambda: two(F.floor(rest / 1000) % 60),
    }[name]()


def format_date(v: Val, pattern: Val | None = None, *_: Val) -> Val:
    ms = digits("formatDate", v)
    if pattern is None or pattern.kind != "string" or not pattern.known:
        raise ExpressionTypeError("formatDate", "a format that is known when compiling", "undefined" if pattern is None else pattern.label)
    parts, used, rest = [], set(), pattern.const
    while found := re.search("|".join(f for f in FIELDS if f not in used) or "(?!)", rest):
        used.add(found[0])
        parts += [F.lit(rest[: found.start()]), _field(found[0], ms)]
        rest = rest[found.end() :]
    shown = F.concat(*parts, F.lit(rest))
    bad = F.isnan(ms) | F.abs(ms).isin(float("inf"))
    return t.of(F.when(bad, F.raise_error(F.lit('"formatDate" expects a finite number'))).otherwise(shown), t.STRING)


def diff_days(v: Val, other: Val, *_: Val) -> Val:
    return t.of(F.abs(rounded((digits("diffDays", v) - digits("diffDays", other)) / DAY)), t.DOUBLE)


def dates(engine) -> None:
    engine.add_function("now", lambda *_: t.of(F.unix_millis(F.current_timestamp()).cast("double"), t.DOUBLE))
    engine.add_transform("formatDate", format_date, accepts=("number",))
    engine.add_transform("diffDays", diff_days, accepts=("number",))
