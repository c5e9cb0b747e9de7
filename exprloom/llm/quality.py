"""Quality selection by importance resampling of hashed n-grams.

Two generative models over hashed word unigrams and bigrams are fitted: the target model on labelled
good text, the raw model on all documents.  A document's importance weight is the ratio of its
likelihoods under the two, the sum over its features of the log ratios of their buckets.  Sampling
without replacement in proportion to the weights is a top-k of log weight plus Gumbel noise, and the
k-th value is found exactly by counting leading bits, never by gathering rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, materialise, texts_of

#: Hash buckets; labelled rows the target model is fitted on at most; pseudo-count.
BUCKETS, SAMPLE, SMOOTH = 10_000, 20_000, 1.0
#: Binary places that the k-th value is found to, and bits of its integer.
PLACES, WIDTH = 20, 62

_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class Features:
    """Bucket numbers of a text's tokens and of its token pairs; words in capitals and repeats carry a mark."""

    def __init__(self) -> None:
        self.memo: Memo = Memo(self.word)

    def word(self, word: str) -> tuple[int, ...]:
        out = []
        for token in _TOKENS.findall(word):
            out.append(zlib.crc32(token.lower().encode()))
            if len(token) > 1 and token.isupper():
                out.append(1)
        return tuple(out)

    def __call__(self, text: str) -> np.ndarray:
        memo = self.memo
        ids = np.array([x for w in text.split() for x in memo[w]], np.uint64)
        pairs = ids[:-1] * np.uint64(0x9E3779B1) + ids[1:] * np.uint64(0x85EBCA77)
        pairs = np.where(ids[:-1] == ids[1:], np.uint64(2), pairs ^ (pairs >> np.uint64(17)))
        return (np.concatenate([ids, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, raw, good = Features(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        size = 0
        for text, quality in zip(texts_of(batch), batch.column("quality").to_pylist(), strict=True):
            held[quality == 1].append(found := features(text))
            size += len(found)
            if size > 1 << 20:
                _add(held, raw, good)
                size = 0
        _add(held, raw, good)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(good)], ["bucket", "raw", "good"])


def _add(held: dict[bool, list[np.ndarray]], raw: np.ndarray, good: np.ndarray) -> None:
    """Add the features of good and other texts to the counts."""
    for is_good, parts in held.items():
        if parts:
            counts = np.bincount(np.concatenate(parts), minlength=BUCKETS)
            raw += counts
            if is_good:
                good += counts
            parts.clear()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Log ratio of target and raw probability for each bucket, and the share of good rows among the labelled ones.

    The raw model counts all documents.  The target model takes the labelled rows whose hashed ids are the ``sample``
    smallest; their ids are few enough to broadcast by that bound.  Without good rows the ratios are 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.0
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select("text", "quality")
    counts = rows.mapInArrow(_count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.sum():
        return np.zeros(BUCKETS), 1.0
    return np.log((good + SMOOTH) / (good + SMOOTH).sum()) - np.log((raw + SMOOTH) / (raw + SMOOTH).sum()), share


def weights(docs: DataFrame, ratio: np.ndarray, seed: int = 1) -> DataFrame:
    """``doc_id``, ``log_weight``, ``gumbel`` (log weight plus Gumbel noise) for each row.  The noise is a function of id, text and
    seed, so that reruns agree; a text without features has log weight 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            sums = [float(ratio[features(text)].sum()) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("draw"), pa.array(sums, pa.float64())], ["doc_id", "draw", "log_weight"])

    rows = docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)).alias("draw"), "text")
    noise = (F.shiftrightunsigned("draw", 12).cast("double") + 0.5) / float(1 << 52)
    return rows.mapInArrow(run, "doc_id long, draw long, log_weight double").select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(noise))).alias("gumbel"))


def _ordered(column: Column) -> Column:
    """A double as an integer of ``WIDTH`` bits in the same order, to ``PLACES`` binary places."""
    return F.round(column * float(1 << PLACES)).cast("long") + F.lit(1 << (WIDTH - 1))


def kth_largest(rows: DataFrame, column: str, k: int, bits: int = 16) -> int | None:
    """The ``k``-th largest value of a double column as :func:`_ordered` gives it, exact: counts by leading bits, then by the
    next bits within the bin that holds it.  At most ``2**bits`` counts reach the driver at a time."""
    rows, fixed, rest, left = rows.select(_ordered(F.col(column)).alias("key")), 0, k, WIDTH
    while left:
        step = min(bits, left)
        bins = rows.where(F.shiftright("key", left) == (fixed >> left)).groupBy(F.shiftright("key", left - step).alias("bin")).count().collect()
        for bin_, n in sorted(((r["bin"], r["count"]) for r in bins), reverse=True):
            if rest <= n:
                fixed = bin_ << (left - step)
                break
            rest -= n
        else:
            return None
        left -= step
    return fixed


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 1, sample: int = SAMPLE) -> DataFrame:
    """The sampled rows of ``docs`` (doc_id, text; more columns are ignored): ``doc_id``, ``log_weight``, ``gumbel``, ``keep`` (true).

    ``share`` of all rows is drawn without replacement by Gumbel top-k; unset, it is the share of good rows among
    ``labels`` (doc_id, quality).  Rows that tie with the last drawn to six decimals are drawn too, so repeated rows stay
    together; rows with the same id, or none, but other texts draw noise of their own.  Null and empty texts have weight 1.
    Labels of one id that differ count as good if one is.  Without good labels all rows are drawn.  An empty table gives an
    empty result.
    """
    ratio, good = fit(docs, labels, sample)
    rows = materialise(weights(docs, ratio, seed), "importance-weights")
    k = math.ceil(rows.count() * (good if share is None else share))
    bar = kth_largest(rows, "gumbel", k) if k else None
    if bar is None:
        return rows.where("false").withColumn("keep", F.lit(True))
    return rows.where(_ordered(F.col("gumbel")) >= bar).withColumn("keep", F.lit(True))
