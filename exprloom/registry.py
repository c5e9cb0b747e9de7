"""Transforms and functions that the host registers: builders of columns, or Python code that becomes a UDF."""

from __future__ import annotations

import asyncio
import inspect
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ExpressionTypeError
from .functions import typed as t
from .functions.typed import Val


@dataclass(frozen=True)
class Entry:
    name: str
    fn: Callable[..., Val]
    accepts: tuple[str, ...] | None = None
    spread: bool = False
    host: bool = False

    def build(self, args: list[Val]) -> Val:
        try:
            return self.fn(*args)
        except TypeError as error:
            if "argument" in str(error):
                raise ExpressionTypeError(self.name, "other arguments", str(error)) from None
            raise


class Registry:
    """Two namespaces; ``version`` counts changes, so that compiled expressions notice them."""

    def __init__(self) -> None:
        self.transforms: dict[str, Entry] = {}
        self.functions: dict[str, Entry] = {}
        self.version = 0

    def add(self, table: dict[str, Entry], name: str, fn: Callable, accepts=None, spread: bool = False, returns: str | T.DataType | None = None, vectorized: bool = False) -> None:
        if returns is None:
            if inspect.iscoroutinefunction(fn):
                raise TypeError(f'"{name}" is asynchronous: give the type it returns')
        else:
            fn = as_udf(fn, returns, vectorized)
        table[name] = Entry(name, fn, tuple(accepts) if accepts else None, spread, returns is not None)
        self.version += 1

    def remove(self, table: dict[str, Entry], name: str) -> bool:
        self.version += name in table
        return table.pop(name, None) is not None


def as_udf(fn: Callable, returns: str | T.DataType, vectorized: bool) -> Callable[..., Val]:
    """Python code as a column builder: Arrow batches for plain functions, one gathered batch for coroutines, and pandas
    series for code that is vectorised already."""
    type_ = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    if inspect.iscoroutinefunction(fn):

        def gathered(*series: pd.Series) -> pd.Series:
            async def every():
                return await asyncio.gather(*[fn(*row) for row in zip(*series, strict=True)])

            return pd.Series(asyncio.run(every()), dtype=object)

        with warnings.catch_warnings():  # type hints can't say "any number of series"
            warnings.simplefilter("ignore")
            udf = F.pandas_udf(gathered, type_, F.PandasUDFType.SCALAR)
    elif vectorized:
        udf = F.pandas_udf(fn, type_)
    else:
        udf = F.udf(fn, type_, useArrow=True)

    def build(*args: Val) -> Val:
        if not args:  # a batch without columns would have no rows
            return as_udf(_ignoring_rows(fn), returns, False)(t.number(0))
        return t.of(udf(*[t.as_double(a) if a.kind == "number" else a.col for a in args]), type_)

    return build


def _ignoring_rows(fn: Callable) -> Callable:
    """``fn`` without arguments, to be called for a row."""
    if inspect.iscoroutinefunction(fn):

        async def later(_):
            return await fn()

        return later
    return lambda _: fn()
