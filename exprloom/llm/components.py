"""Connected components as alternating large-star and small-star rounds over an edge table.

Every round is a pair of aggregations and joins on node ids; no adjacency list is ever gathered, so
a hub with any number of neighbours costs one partially aggregated minimum and one join.  The minima
are written before the join: only a join of two plain exchanges can be split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    least = materialise(least, "least")
    out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    return _written(out, "edges", least)


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("a > b")
    least = materialise(down.groupBy("a").agg(F.min("b").alias("least")), "least")
    joined = down.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _written(joined.unionAll(least.select("a", F.col("least").alias("b"))).distinct(), "edges", least)


def _written(out: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """``out`` as a table of its own; the tables it was made of are not needed any more."""
    made = materialise(out, name)
    for table in used:
        discard(table)
    return made


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: two long columns ``a``, ``b``.  Returns ``node``, ``root`` for every node that has an
    edge to another node and is not itself the root; the root is the component's smallest node.

    Self-loops and repeated edges are ignored; an empty table gives an empty result.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        large = _large_star(now)
        discard(now)
        now = _small_star(large)
        discard(large)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
