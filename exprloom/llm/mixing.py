"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source has a token budget (its target) and a schedule: its relative weight as a function of
training progress from 0 to 1, linear between knots.  The integral of the schedule, scaled to the
budget, is the number of tokens of that source the training has asked for by then.  A source's
documents stand in a fixed pseudo-random order, repeated once per pass; a document's training
position is the progress at which cumulative demand reaches its first token, found by inverting the
integral.  Documents are then range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Hex digits of a document's hash that name its cell; sums over cells make prefix sums distributed.
CELL_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Schedules by weight class: (progress, relative weight) knots.  Heavy sources stay level, middle ones
#: rise towards the end of the training, light ones fall.
SCHEDULES = {5: ((0.0, 1.0), (1.0, 1.0)), 2: ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)), 1: ((0.0, 1.5), (0.7, 1.0), (1.0, 0.25))}


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from ``sizes`` (source, source_size): one row a source.

    Sources in order of their code points, null last, get ``weights`` in turn and share ``share`` times
    all sizes by weight; no target exceeds ``most`` times its source, and what that leaves over goes to
    the others by weight, again and again.  That ends in target = min(cap, weight * level) with one
    level for all, found in order of cap / weight.  The table has a row per source, so windows over all
    of it are small however many documents there are.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * F.lit(float(most))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("cap", cap)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("filled", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    rows = rows.withColumn("at", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")))
    level = F.first("at", ignorenulls=True).over(everything)
    target = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", F.col("weight").cast("int").alias("weight"), target.alias("target"))


def _area(t0: float, w0: float, t1: float, w1: float) -> float:
    return (t1 - t0) * (w0 + w1) / 2


def progress(demand: Column, weight: Column, schedules: dict) -> Column:
    """Training progress at which a source of that weight class has met ``demand`` (0 to 1) of its budget:
    the inverse of the integral of its schedule, a quadratic on each piece."""
    out = None
    for name, knots in schedules.items():
        whole, before, pieces = sum(_area(*a, *b) for a, b in zip(knots, knots[1:], strict=False)), 0.0, None
        asked = demand * F.lit(whole)
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            rest, slope = asked - F.lit(before), (w1 - w0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            at = F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + root)
            before += _area(t0, w0, t1, w1)
            pieces = F.when(asked < F.lit(before), at) if pieces is None else pieces.when(asked < F.lit(before), at)
        case = pieces.otherwise(F.lit(1.0))
        out = F.when(weight == name, case) if out is None else out.when(weight == name, case)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, schedules: dict | None = None) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source; more columns are ignored), one row a document.

    Returns ``doc_id``, ``size`` (words), ``source``, ``source_size``, ``target``, ``taken`` (words the mix takes
    of the document over all passes) and ``positions`` (its training position in each pass that takes any of
    it), range-sorted by first position; what is not taken comes last.  The last document of a source's budget
    is cut where the budget ends, so a source's taken words miss its target by less than one word.

    Texts are counted whole, however long.  Null text has size 0.  Null is a source of its own, the last.  Documents are ordered within their source
    by the MD5 of their id, then id, then size; repeated rows are separate documents that give the same rows in
    every run.  An empty table gives an empty result; where all sizes are 0, targets are 0.
    """
    weight_classes = schedules or SCHEDULES
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # Texts are read once; what follows needs only their sizes.
    rows = materialise(docs.select("doc_id", "source", size.alias("size"), order.alias("order")), "document-sizes")
    rows = rows.withColumn("cell", F.substring("order", 1, CELL_DIGITS))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_size")
    cells = cells.select("source", "cell", before.alias("before"))
    totals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    placed = cells.alias("c").join(totals.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "c.cell", "before", "source_size", "weight", "target")
    within = Window.partitionBy("source", "cell").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(placed, same(rows, placed) & (rows["cell"] == placed["cell"])).select(rows["doc_id"], rows["size"], rows["source"], "order", "source_size", "weight", "target", (F.col("before") + F.col("inside")).alias("start"))
    budget = F.floor("target")
    starts = [F.col("start") + F.col("source_size") * p for p in range(int(most))]
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), budget - s)) for s in starts]
    spots = [F.when(part > 0, progress(s / F.col("target"), F.col("weight"), weight_classes)) for s, part in zip(starts, parts, strict=True)]
    taken = sum(parts[1:], parts[0]).cast("long")
    rows = rows.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), F.array_compact(F.array(*spots)).alias("positions"), "order")
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    return rows.orderBy(first, "order", "doc_id").drop("order")


def schedule_rows(docs: DataFrame, **options) -> DataFrame:
    """The training order itself: one row for each pass over a document, by ``position``."""
    return mix(docs, **options).select("doc_id", "source", F.posexplode("positions").alias("epoch", "position")).orderBy("position", "doc_id", "epoch")


def progress_sql(demand: str, weight: str, schedules: dict) -> str:
    """:func:`progress` in SQL, operation by operation."""
    cases = []
    for name, knots in schedules.items():
        whole, before, pieces = sum(_area(*a, *b) for a, b in zip(knots, knots[1:], strict=False)), 0.0, []
        asked = f"({demand} * {whole!r}::DOUBLE)"
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            rest, slope = f"({asked} - {before!r}::DOUBLE)", (w1 - w0) / (t1 - t0)
            root = f"sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0.0::DOUBLE))"
            before += _area(t0, w0, t1, w1)
            pieces.append(f"WHEN {asked} < {before!r}::DOUBLE THEN {t0!r}::DOUBLE + 2.0::DOUBLE * {rest} / ({w0!r}::DOUBLE + {root})")
        cases.append(f"WHEN {weight} = {name} THEN CASE {' '.join(pieces)} ELSE 1.0::DOUBLE END")
    return f"CASE {' '.join(cases)} END"


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
s AS (SELECT source, sum(size) AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
g AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
h AS (SELECT *, (SELECT max(level) FROM g WHERE level * weight < cap) AS lev FROM g),
t AS (SELECT source, source_size, weight, least(cap, coalesce(lev * weight, cap)) AS target FROM h),
p AS (SELECT d.doc_id, d.size, t.source_size, t.weight, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)))::BIGINT AS taken,
       CASE WHEN least(size, floor(target) - start) > 0 THEN FIRST_PASS END AS first_position,
       CASE WHEN least(size, floor(target) - start - source_size) > 0 THEN SECOND_PASS END AS second_position
FROM p
"""
SQL = SQL.replace("FIRST_PASS", progress_sql("(start::DOUBLE / target)", "weight", SCHEDULES)).replace("SECOND_PASS", progress_sql("((start + source_size)::DOUBLE / target)", "weight", SCHEDULES))
