"""Expressions over streams: a compiled column keeps no state, so it applies to a streaming DataFrame as it stands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def rules(engine: Engine, stream: DataFrame, where: str | None = None, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Filter and project a stream by expressions.  Output mode append works, as nothing is aggregated."""
    if where is not None:
        stream = engine.where(stream, where)
    return engine.select(stream, columns) if columns else stream


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet, taking what is there now and stopping."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
