"""Links inside blocks of any size, without comparing every two members of a large one.

Only the components of all links matter, so a pair need not be compared once other links join it.  A large
block is dealt into chunks.  First each chunk is searched alone, which reads every row once, and one
member of each component found is compared with those of the other chunks.  What is then joined by links
anywhere needs no more; the members outside the block's largest component are few where the block is a
dense group, and only they meet all chunks, each pair of chunks in a task of its own.  No pair of different
components is left out, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import connected_components


def pieces(rows: Column, terms: Column, chunk: int, most_terms: int) -> Column:
    """How many chunks so many rows and terms make."""
    return F.greatest(F.ceil(rows / chunk), F.ceil(terms / most_terms), F.lit(1)).cast("int")


def dealt(salt: str, node: str, count: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col(node)), F.col(count)).cast("int")


def links(members: DataFrame, compare: Callable[[DataFrame], DataFrame], chunk: int, most_terms: int) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all links inside blocks.

    ``members`` has ``block``, ``node``, ``terms`` (its size) and ``pieces`` (of its block), and is a table; ``compare`` gives
    the edges of a spanning forest of the links in each group of rows (block, x, y, node).
    """
    mine = dealt("chunk", "node", "pieces")
    edges = materialise(compare(members.select("block", mine.alias("x"), mine.alias("y"), "node")), "chunk-links")
    large = members.where("pieces > 1")
    if large.isEmpty():
        return edges
    labelled = _labelled(large, edges)
    ends = labelled.groupBy("block", "root").agg(F.min("node").alias("node"), F.max("terms").alias("terms"))
    mixed = materialise(ends.groupBy("block").agg(F.count("*").alias("n"), F.sum("terms").alias("terms")).where("n > 1").select("block", pieces(F.col("n"), F.col("terms"), chunk, most_terms).alias("pieces")), "mixed-blocks")
    ends = ends.select("block", "node").join(mixed, "block").select("block", "node", dealt("ends", "node", "pieces").alias("x"))
    joined = materialise(edges.unionAll(compare(ends.select("block", "x", F.col("x").alias("y"), "node"))), "chunk-links")
    for table in (edges, labelled, mixed):
        discard(table)
    labelled = _labelled(large, joined)
    parts = materialise(labelled.groupBy("block", "root").agg(F.count("*").alias("n"), F.sum("terms").alias("terms")), "block-parts")
    whole = parts.groupBy("block").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms"), F.max(F.struct("n", "root", "terms")).alias("first")).where("n > first.n")
    split = whole.select("block", F.col("first.root").alias("first"), pieces(F.col("n"), F.col("terms"), chunk, most_terms).alias("chunks"), pieces(F.col("n") - F.col("first.n"), F.col("terms") - F.col("first.terms"), chunk, most_terms).alias("others"))
    split = materialise(split, "split-blocks")
    discard(parts)
    if split.isEmpty():
        return joined
    rows = labelled.join(split, "block").select("block", "node", (F.col("root") != F.col("first")).alias("other"), "chunks", "others", dealt("chunk", "node", "chunks").alias("i"), dealt("other", "node", "others").alias("j"))
    upto = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    own = F.transform(upto("others"), lambda j: F.struct(F.col("i").alias("x"), j.alias("y")))
    met = F.when(F.col("other"), F.transform(upto("chunks"), lambda i: F.struct(i.alias("x"), F.col("j").alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    cells = rows.select("block", "node", F.explode(F.array_distinct(F.concat(own, met))).alias("at")).select("block", "at.x", "at.y", "node")
    return joined.unionAll(compare(cells))


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``block``, ``node``, ``terms`` and the ``root`` of the component that the edges give a node."""
    roots = connected_components(edges)
    return materialise(members.select("block", "node", "terms").join(roots, "node", "left").select("block", "node", "terms", F.coalesce("root", "node").alias("root")), "block-roots")
