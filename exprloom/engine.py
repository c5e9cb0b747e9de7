"""The engine: options, registry, compilation, and expressions over DataFrames."""

from __future__ import annotations

import asyncio
import threading
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cache import Cache
from .errors import ExpressionError, Position, SecurityError, format_any, position_at
from .plans.fold import fold
from .plans.lower import Lowering
from .policy import Options, Policy
from .registry import Registry
from .sources import from_contexts
from .syntax import nodes as n
from .syntax import parse


@dataclass(frozen=True)
class References:
    """Names an expression uses, each once, in order."""

    identifiers: tuple[str, ...] = ()
    transforms: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Problem:
    message: str
    formatted: str
    start: int
    end: int
    position: Position


@dataclass(frozen=True)
class Validation:
    valid: bool
    ast: n.Node | None = None
    references: References = field(default_factory=References)
    errors: tuple[Problem, ...] = ()
    warnings: tuple[str, ...] = ()


def references(node: n.Node, keys: bool = True) -> References:
    """The names in a tree, however deep.  Keys of object literals count as identifiers unless ``keys`` is off, which leaves
    the columns an expression reads."""
    names: dict[str, dict[str, None]] = {"identifiers": {}, "transforms": {}, "functions": {}}
    rest: list[n.Node | tuple[str, str]] = [node]
    while rest:
        x = rest.pop()
        if isinstance(x, tuple):
            names[x[0]].setdefault(x[1])
            continue
        if isinstance(x, n.Identifier):
            names["identifiers"].setdefault(x.name)
            continue
        parts: list[n.Node | tuple[str, str]]
        if isinstance(x, (n.MemberExpression, n.OptionalMemberExpression)):
            parts = [x.object, x.property] if x.computed else [x.object]
        elif isinstance(x, n.CallExpression):
            named = isinstance(x.callee, n.Identifier)
            parts = [("functions", x.callee.name) if named else x.callee, *x.args]
        elif isinstance(x, n.PipeExpression):
            called = isinstance(x.transform, n.CallExpression)
            stage = x.transform.callee if called else x.transform
            parts = [x.input, *(x.transform.args if called else ())]
            if isinstance(stage, n.Identifier):
                parts.append(("transforms", stage.name))
        elif isinstance(x, n.ObjectProperty):
            parts = [x.key, x.value] if x.computed or keys else [x.value]
        else:
            parts = list(x.children())
        rest += reversed(parts)
    return References(*(tuple(names[k]) for k in ("identifiers", "transforms", "functions")))


#: Deeper trees are refused before anything walks them by recursion; folding may make shallower ones pass.
DEEPEST = 200


class CompiledExpression:
    """An expression bound to a schema.  ``column`` and ``data_type`` follow later changes of the registry."""

    def __init__(self, engine: Engine, source: str, schema: T.StructType):
        self.engine, self.source, self.schema = engine, source, schema
        tree, most = engine.parse(source), max(DEEPEST, engine.options.max_depth)
        if n.depth(tree, most) > most:
            raise SecurityError("MAX_DEPTH", f"Expression depth exceeds the limit of {engine.options.max_depth}")
        try:
            self.ast = fold(tree)
        except RecursionError:
            raise SecurityError("MAX_DEPTH", "Expression is nested too deeply") from None
        self.references = references(self.ast)
        self._at, self._value = -1, None

    def _lowered(self):
        if self._at != self.engine.registry.version:
            try:
                self._value, self._at = self.engine._lowering(self.source, self.schema).value(self.ast), self.engine.registry.version
            except RecursionError:
                raise SecurityError("MAX_DEPTH", "Expression is nested too deeply") from None
        return self._value

    @property
    def column(self) -> Column:
        return self._lowered().col

    @property
    def data_type(self) -> T.DataType:
        return self._lowered().type

    @property
    def predicate(self) -> Column:
        """The expression's truth in the form that scans can apply."""
        return self.engine._lowering(self.source, self.schema).predicate(self.ast)

    def evaluate(self, context: Mapping[str, Any]) -> Any:
        return self.engine.evaluate(self.source, context)


class Engine:
    """Compiles expressions to columns.  Options: see :class:`exprloom.policy.Options`."""

    def __init__(self, **options: Any):
        self.options = Options.of(**options)
        self.policy, self.registry = Policy(self.options), Registry()
        self._trees, self._compiled = Cache(self.options.cache_size), Cache(self.options.cache_size)

    # Registry.

    def use(self, plugin: Callable[[Engine], None]) -> Engine:
        plugin(self)
        return self

    def add_transform(self, name: str, fn: Callable, **how: Any) -> Engine:
        """Register ``fn(value, *args)`` for ``value |> name(args)``: a builder over typed columns, or with ``returns=`` (a
        Spark type) plain, asynchronous or (``vectorized=True``) pandas code."""
        self.registry.add(self.registry.transforms, name, fn, **how)
        return self

    def add_function(self, name: str, fn: Callable, **how: Any) -> Engine:
        self.registry.add(self.registry.functions, name, fn, **how)
        return self

    def remove_transform(self, name: str) -> bool:
        return self.registry.remove(self.registry.transforms, name)

    def remove_function(self, name: str) -> bool:
        return self.registry.remove(self.registry.functions, name)

    def has_transform(self, name: str) -> bool:
        return name in self.registry.transforms

    def has_function(self, name: str) -> bool:
        return name in self.registry.functions

    def list_transforms(self) -> list[str]:
        return list(self.registry.transforms)

    def list_functions(self) -> list[str]:
        return list(self.registry.functions)

    def get_policy(self) -> dict:
        return self.policy.describe()

    def clear_cache(self) -> None:
        self._trees.clear()
        self._compiled.clear()

    # Compilation.

    def parse(self, source: str) -> n.Node:
        standard = self.options.lambda_precedence == "standard"
        return self._trees.get(source, lambda: parse(source, standard))

    def _lowering(self, source: str, schema: T.StructType) -> Lowering:
        return Lowering(source, schema, self.registry, self.policy)

    def compile(self, source: str, schema: T.StructType | DataFrame) -> CompiledExpression:
        schema = schema.schema if isinstance(schema, DataFrame) else schema
        key = (source, schema.json())
        return self._compiled.get(key, lambda: CompiledExpression(self, source, schema))

    def validate(self, source: str) -> Validation:
        """Parse only; never raises."""
        try:
            tree = self.parse(source)
        except ExpressionError as e:
            problem = Problem(e.raw_message, format_any(e), e.start, e.end, position_at(source, e.start))
            return Validation(False, errors=(problem,))
        other = parse(source, self.options.lambda_precedence != "standard")
        warnings = () if n.same_tree(other, tree) else ("operators after a lambda on the right of an operator belong to that lambda",)
        return Validation(True, tree, references(tree), warnings=warnings)

    # Over DataFrames, batch or streaming.

    def column(self, source: str, df: DataFrame) -> Column:
        return self.compile(source, df).column

    def where(self, df: DataFrame, source: str) -> DataFrame:
        return df.where(self.compile(source, df).predicate)

    def select(self, df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        return df.select(*[self.column(source, df).alias(name) for name, source in columns.items()])

    def with_columns(self, df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        return df.withColumns({name: self.column(source, df) for name, source in columns.items()})

    # Over one context.

    def evaluate(self, source: str, context: Mapping[str, Any] | None = None) -> Any:
        """The value for one context object, through a DataFrame of one row; a timeout cancels the job."""
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        df = from_contexts(spark, [dict(context or {})])
        value = self.compile(source, df).column
        rows = self.collect(df.select(value.alias("value")))
        return plain(rows[0]["value"])

    async def evaluate_async(self, source: str, context: Mapping[str, Any] | None = None) -> Any:
        """As :meth:`evaluate`, without blocking the event loop."""
        return await asyncio.to_thread(self.evaluate, source, context)

    def collect(self, df: DataFrame) -> list[T.Row]:
        """The rows of ``df``; an action longer than the timeout is cancelled and raises TIMEOUT."""
        if not self.options.timeout:
            return df.collect()
        sc, tag, late = df.sparkSession.sparkContext, f"exprloom-{uuid.uuid4().hex}", threading.Event()

        def cancel() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.options.timeout / 1000, cancel)
        sc.addJobTag(tag)
        timer.start()
        try:
            return df.collect()
        except Exception as error:
            if late.is_set():
                raise SecurityError("TIMEOUT", f"Evaluation took longer than {self.options.timeout} ms") from error
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)


def plain(value: Any) -> Any:
    """Rows and variants as Python values."""
    if isinstance(value, T.Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return plain(value.toPython()) if hasattr(value, "toPython") else value


_default: list[Engine] = []


def evaluate_expression(source: str, context: Mapping[str, Any] | None = None) -> Any:
    """One evaluation with a shared engine that has no plugins."""
    if not _default:
        _default.append(Engine())
    return _default[0].evaluate(source, context)
