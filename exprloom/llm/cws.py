"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

Terms are words, by their 64-bit hashes, weighted by how often they occur.  For each term a sampler has
r and c from Gamma(2, 1) and b from U(0, 1), all from hashes of term and sampler.  For weight w it
takes t = floor(ln w / r + b) and a = c exp(-r (t - b + 1)); the sample is the term and t with the least a.
Two documents share a sample with probability equal to their generalised Jaccard similarity, the sum
of the lesser weights over the sum of the greater.  Since a is a function of term and t, and
continuous, the least a stands for the sample.

A uniform b splits r into r b and r (1 - b), two independent exponentials, so both are drawn as such:
r (1 - b) = -ln v makes a = c v exp(-r t), which needs one logarithm for c and no more where t is 0, as
it is for every term that occurs once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, SEED = 64, 7
#: Documents of one bucket of neighbours on average, and how many buckets there are at most: beyond, buckets grow.  A
#: bucket is only ever sorted and streamed, so its size bounds no memory.
BUCKET, MOST_BUCKETS = 64, 65_536


def _uniform(h: Column, shift: int, bits: int) -> Column:
    """A number in the open interval (0, 1) from some bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * 2.0**-bits


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: what a lambda captures is otherwise computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_weights(text: Column) -> Column:
    """Array of (term, w): the 64-bit hashes of a text's words with their counts; null for null or blank texts."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    ids = F.sort_array(F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w)))

    def count(ids: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(ids)), lambda i: (i == F.size(ids)) | (F.get(ids, i) != F.get(ids, i - 1)))
        return _let(ends, lambda e: F.transform(e, lambda x, j: F.struct(F.get(ids, x - 1).alias("term"), (x - F.when(j > 0, F.get(e, j - 1)).otherwise(0)).alias("w"))))

    return _let(ids, lambda x: F.when(F.size(x) > 0, count(x)))


def sample(term: Column, ln_w: Column, k: int, seed: int = SEED) -> Column:
    """The value a of sampler ``k`` for a term of weight exp(``ln_w``), at least 1; null for no weight.  One hash holds all that
    a term of weight 1 needs."""
    h = F.xxhash64(term, F.lit(seed + 2 * k))
    v = _uniform(h, 42, 22)
    first = -F.log(_uniform(h, 0, 21) * _uniform(h, 21, 21)) * v
    near = -F.log(_uniform(F.xxhash64(term, F.lit(seed + 2 * k + 1)), 11, 53))  # r b
    r = near - F.log(v)
    t = F.floor((ln_w + near) / r)
    return F.when(ln_w == 0.0, first).otherwise(first * F.when(t == 0, F.lit(1.0)).otherwise(F.exp(-r * t)))


def sketch(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """``keys`` and ``signature`` (array of samples reduced to 16 bits) for each row; ``keys`` must tell rows apart.

    A text without words has the signature of zeros, which is like its own kind only."""
    terms = rows.select(*keys, F.explode_outer(term_weights(F.col(text))).alias("x")).select(*keys, F.col("x.term").alias("term"), F.log(F.col("x.w").cast("double")).alias("ln_w"))
    least = terms.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("ln_w"), k, seed)).alias(f"a{k}") for k in range(samples)])
    values = F.array(*[F.coalesce(F.pmod(F.xxhash64(f"a{k}"), F.lit(65535)) + 1, F.lit(0)).cast("int") for k in range(samples)])
    return least.select(*keys, F.when(F.col("a0").isNull(), F.array_repeat(F.lit(0), samples)).otherwise(values).alias("signature"))


def as_text(signature: Column) -> Column:
    """Four lower-case hex digits a sample."""
    return F.array_join(F.transform(signature, lambda s: F.lpad(F.lower(F.hex(s)), 4, "0")), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same.cast("double") / F.lit(float(samples))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id``, ``signature`` for each row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    return sketch(rows, ["_row", "doc_id"], "text", samples).select("doc_id", "signature")


def place(doc_id: Column, text: Column) -> Column:
    """A string whose order is that of rows: by id, null last, then by a hash of the text."""
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.concat(F.when(doc_id.isNull(), "1").otherwise("0"), digits(F.coalesce(doc_id, F.lit(0)).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), digits(F.xxhash64(text)))


def _cuts(places: DataFrame) -> tuple[list[str], str | None]:
    """Places that begin a bucket, and the first place.  Rows whose hashed place is divisible by the mean size of a bucket
    are cuts, about ``MOST_BUCKETS`` at most; they are all that reaches the driver."""
    n, first = places.agg(F.count("place"), F.min("place")).first()
    every = max(BUCKET, math.ceil(n / MOST_BUCKETS))
    found = places.where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).distinct().collect() if n > every else []
    return sorted(r[0] for r in found if r[0] > first), first


def _dealt(rows: DataFrame) -> DataFrame:
    """Documents (doc_id, text, place) with their ``bucket``: neighbours share one.  The first document of each bucket also
    stands, as a ghost, behind the last of the bucket before, and the first of all behind the last of all."""
    cuts, first = _cuts(rows.select("place"))
    here, last = F.col("place"), len(cuts)
    home, begins = F.lit(0), F.lit(False)
    if cuts:
        fan = math.isqrt(len(cuts)) + 1
        listed = lambda names: F.split(F.lit(",".join(names)), ",")
        groups = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
        heads, nested = listed([g[0] for g in groups]), F.array(*map(listed, groups))
        coarse = F.size(F.filter(heads, lambda x: x <= here))
        group = F.get(nested, coarse - 1)
        home = F.when(coarse > 0, (coarse - 1) * fan + F.size(F.filter(group, lambda x: x <= here))).otherwise(0)
        begins = F.coalesce(F.array_contains(group, here), F.lit(False))
    rows = rows.select("doc_id", "text", "place", home.cast("int").alias("home"), begins.alias("begins"), here.eqNullSafe(F.lit(first)).alias("is_first"))
    at = lambda b, ghost: F.struct(b.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    spots = F.array_compact(F.array(at(F.col("home"), 0), F.when(F.col("begins"), at(F.col("home") - 1, 1)), F.when(F.col("is_first"), at(F.lit(last), 1))))
    return rows.select("doc_id", "text", "place", F.explode(spots).alias("at")).select("doc_id", "text", "place", "at.bucket", "at.ghost")


def report(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text; more columns are ignored) and of its edited text, in which the
    last half is replaced by the beginning of the next document by ascending id; after the last comes the first.

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``signature``, ``edited``, ``near_edited``, ``near_next``.  Null is the empty
    text.  Rows with the same id follow each other by a hash of their text; null ids come last.  A single row is its own
    next.  An empty table gives an empty result.

    Texts are shuffled once, to buckets of neighbours; neighbours, terms, samples and the next fingerprint all use that
    one partitioning.
    """
    text = F.coalesce("text", F.lit(""))
    rows = _dealt(docs.select("doc_id", text.alias("text"), place(F.col("doc_id"), text).alias("place")))
    within = Window.partitionBy("bucket").orderBy("ghost", "place")
    rows = rows.select("doc_id", "text", "bucket", "ghost", F.row_number().over(within).alias("row"), F.lead("text").over(within).alias("next"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", "bucket", "ghost", "row", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body"), F.lit("").alias("sha")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"), F.sha2("edited", 256).alias("sha")))
    both = F.when(F.col("ghost") == 0, both).otherwise(F.slice(both, 1, 1))
    rows = rows.select("doc_id", "bucket", "ghost", "row", "n_chars", F.explode(both).alias("v")).select("doc_id", "bucket", "ghost", "row", "n_chars", "v.kind", "v.body", "v.sha")
    keys = ["bucket", "row", "ghost", "doc_id", "n_chars", "kind", "sha"]
    made = sketch(rows, keys, "body", samples)
    by = Window.partitionBy("bucket").orderBy("row")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    made = made.groupBy("bucket", "row", "ghost", "doc_id", "n_chars").agg(pick(1, "sha").alias("edited_sha256"), pick(0, "signature").alias("signature"), pick(1, "signature").alias("edited"))
    made = made.withColumn("next", F.lead("signature").over(by)).where("ghost = 0")
    return made.select("doc_id", "n_chars", "edited_sha256", "signature", "edited", likeness(F.col("signature"), F.col("edited"), samples).alias("near_edited"), likeness(F.col("signature"), F.col("next"), samples).alias("near_next"))
