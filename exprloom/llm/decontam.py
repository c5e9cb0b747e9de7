"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A benchmark item is cut into windows of consecutive words, a window into word shingles, its tokens.
One scan of the documents splits each text once, hashes each word once, and keeps the positions
whose shingle is, word for word, one of the benchmark's.  All that follows works on those positions
alone.  Tokens are ordered by how rare they are over all documents; since a window counts only if
it is wholly contained, its one rarest token is a sufficient prefix.  Positions are joined with
prefix tokens, length and position bounds discard what can't hold the whole window, and a window
is verified by looking up the exact shingles that tile it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 5
#: Bytes up to which a side is broadcast; a larger one is joined by shuffling both sides.
BROADCAST_BYTES = 32 << 20
#: What a row costs in a hash table beyond its strings.
ROW_BYTES = 64
#: Bits of the filter that spares most positions the shuffle where the benchmark is too large to broadcast: 32 for each token,
#: within these powers of two.
FILTER_BITS = (16, 24)


class Found(NamedTuple):
    """``sizes``: ``doc_id``, ``text_hash``, ``n_words`` of each document; ``hits``: ``doc_id``, ``text_hash``, ``first``, ``last``
    (word positions, last exclusive), ``window`` for every occurrence of a window; ``items``: ``window``, ``item``."""

    sizes: DataFrame
    hits: DataFrame
    items: DataFrame


def pieces(text: Column) -> Column:
    """The words of a text in order; an empty string may stand before the first and behind the last."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN)


def _ends(w: Column) -> Column:
    """How many empty strings stand at the ends of ``pieces``."""
    last = F.when(F.size(w) > 1, (F.element_at(w, -1) == "").cast("int")).otherwise(0)
    return (F.get(w, F.lit(0)) == "").cast("int") + last


def token(hashes: Column, at: Column, size: int) -> Column:
    """Hash of the shingle of ``size`` words that begins at ``at`` (0-based), from the hashes of the words."""
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(size)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``window`` (a number), ``words``, ``len``: each distinct window; and ``window``, ``item``: the ids, as strings, of its items."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.array_remove(pieces(F.col("text")), "").alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("len", F.least(F.size("w"), F.lit(window)))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))))
    rows = rows.select(F.slice("w", F.col("at") + 1, F.col("len")).alias("words"), "item").distinct()
    rows = materialise(rows, "window-items")
    table = materialise(rows.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words", F.size("words").alias("len")), "windows")
    return table, rows.join(table, "words").select("window", "item")


def _tokens(table: DataFrame, shingle: int, sizes: Sequence[int]) -> DataFrame:
    """Every token of every window: ``window``, ``len``, ``offset``, ``size``, ``token`` and the shingle's words ``said``."""
    size = F.least("len", F.lit(shingle))
    each = table.select("window", "words", "len", size.alias("size"), F.transform("words", lambda x: F.xxhash64(x)).alias("h"), F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("offset"))
    case = F.lit(None).cast("long")
    for n in sizes:
        case = F.when(F.col("size") == n, token(F.col("h"), F.col("offset"), n)).otherwise(case)
    return each.select("window", "len", "offset", "size", case.alias("token"), F.slice("words", F.col("offset") + 1, F.col("size")).alias("said"))


def _fits_broadcast(table: DataFrame, size: Column, limit: int) -> bool:
    return (table.agg(F.sum(size + F.lit(ROW_BYTES))).first()[0] or 0) <= limit


def _scan(docs: DataFrame, shingles: DataFrame, sizes: Sequence[int], limit: int) -> DataFrame:
    """The one pass over the texts: a row for each position that begins a shingle of the benchmark, and at least one row a
    document, whose ``shingle`` may be null: ``doc_id``, ``text_hash``, ``n_words``, ``width`` (of ``pieces``), ``pos``, ``shingle``."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), pieces(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "text_hash", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    rows = rows.select("doc_id", "text_hash", "w", "h", F.posexplode("h").alias("pos", "one"))
    if len(sizes) == 1:
        rows = rows.withColumn("size", F.lit(sizes[0])).withColumn("token", token(F.col("h"), F.col("pos"), sizes[0]))
    else:
        every = F.array(*[F.struct(F.lit(n).alias("size"), token(F.col("h"), F.col("pos"), n).alias("token")) for n in sizes])
        rows = rows.select("doc_id", "text_hash", "w", "pos", F.explode(every).alias("s")).select("doc_id", "text_hash", "w", "pos", "s.size", "s.token")
    anchor = (F.col("pos") == 0) & (F.col("size") == sizes[0])
    rows = rows.withColumn("anchor", anchor)
    n_words = (F.size("w") - _ends(F.col("w"))).cast("long").alias("n_words")
    given = shingles.select("token", "said", "shingle")
    out = ["doc_id", "text_hash", "n_words", "width", "pos", "shingle", "anchor"]
    if _fits_broadcast(shingles, F.octet_length(F.array_join("said", " ")), limit):
        same = (F.col("d.token") == F.col("s.token")) & (F.slice("d.w", F.col("d.pos") + 1, F.col("d.size")) == F.col("s.said"))
        joined = rows.alias("d").join(F.broadcast(given).alias("s"), same, "left").where(F.col("shingle").isNotNull() | F.col("anchor"))
        return joined.select("doc_id", "text_hash", n_words, F.size("w").alias("width"), "pos", "shingle", "anchor")
    near = rows.where(_maybe(given, F.col("token")) | F.col("anchor"))
    near = near.select("doc_id", "text_hash", n_words, F.size("w").alias("width"), "pos", "anchor", "token", F.slice("w", F.col("pos") + 1, F.col("size")).alias("said"))
    return near.join(given, ["token", "said"], "left").where(F.col("shingle").isNotNull() | F.col("anchor")).select(*out)


def _maybe(shingles: DataFrame, token: Column) -> Column:
    """Whether a token may be one of the shingles': false for most that are not, by a bitmap whose size the parameters bound."""
    least, most = FILTER_BITS
    bits = min(most, max(least, (32 * max(1, shingles.count())).bit_length()))
    place = lambda t: t.bitwiseAND(F.lit((1 << bits) - 1))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
    at = place(F.col("token"))
    words = shingles.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit(at)).alias("bits")).collect()
    bitmap = [0] * (1 << (bits - 6))
    for r in words:
        bitmap[r["word"]] = r["bits"]
    stored = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")  # folded to one literal
    p = place(token)
    return F.get(stored, F.shiftright(p, 6).cast("int")).bitwiseAND(bit(p)) != 0


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> Found:
    """Every verified occurrence of a window of ``benchmark`` in ``docs``; see :class:`Found`."""
    table, items = windows(benchmark, window)
    sizes = sorted(r[0] for r in table.select(F.least("len", F.lit(shingle))).distinct().collect()) or [shingle]
    tokens = materialise(_tokens(table, shingle, sizes), "window-tokens")
    shingles = materialise(tokens.select("size", "token", "said").distinct().withColumn("shingle", F.monotonically_increasing_id()), "shingles")
    tokens = materialise(tokens.join(shingles, ["size", "token", "said"]).select("window", "len", "offset", "size", "shingle"), "window-shingles")
    scanned = materialise(_scan(docs, shingles, sizes, broadcast_bytes), "benchmark-shingles")
    places = scanned.where("shingle is not null").select("doc_id", "text_hash", "width", "pos", "shingle")
    seen = places.groupBy("shingle").agg(F.count("*").alias("n"))
    # A window of which a token never occurs can't occur; of the others the rarest token is the prefix.
    ranked = tokens.join(seen, "shingle", "left").groupBy("window", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("rarest"))
    prefix = materialise(ranked.where("rarest.n > 0").select("window", "len", "rarest.offset", "rarest.shingle"), "prefix-tokens")
    first = F.col("pos") - F.col("offset")
    near = places.join(prefix, "shingle").where((first >= 0) & (first + F.col("len") <= F.col("width")))
    near = near.select("doc_id", "text_hash", first.alias("first"), "window", "len")
    tiles = tokens.where("offset % size = 0 or offset = len - size").select("window", "offset", "shingle")
    asked = near.join(tiles, "window").select("doc_id", "text_hash", "first", "len", "window", "shingle", (F.col("first") + F.col("offset")).alias("pos"))
    there = places.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("pos").alias("_pos"), F.col("shingle").alias("_shingle")).distinct()
    missing = asked.join(there, (F.col("text_hash") == F.col("_hash")) & (F.col("pos") == F.col("_pos")) & (F.col("shingle") == F.col("_shingle")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    whole = missing.groupBy("doc_id", "text_hash", "first", "len", "window").agg(F.max(F.col("_pos").isNull()).alias("missing")).where("not missing")
    found = materialise(whole.select("doc_id", "text_hash", "first", (F.col("first") + F.col("len")).alias("last"), "window"), "window-hits")
    return Found(scanned.where("anchor").select("doc_id", "text_hash", "n_words"), found, items)


def hit_documents(found: Found) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_hit``, ``items`` of the documents that hold any window."""
    key = ["doc_id", "text_hash"]
    spans = found.hits.select(*key, "first", "last").distinct()
    reach = F.max("last").over(Window.partitionBy(*key).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    covered = F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce(reach, F.lit(0))))
    words = spans.select(*key, covered.alias("covered")).groupBy(*key).agg(F.sum("covered").cast("long").alias("n_hit"))
    named = found.hits.select(*key, "window").distinct().join(found.items, "window").groupBy(*key, "item").agg(F.count("*").alias("n"))
    names = named.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    same = words["doc_id"].eqNullSafe(names["doc_id"]) & (words["text_hash"] == names["text_hash"])
    return words.join(names, same, "left").select(words["doc_id"], words["text_hash"], "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; more columns are ignored) against ``benchmark`` (item_id, text):
    ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items``, ``items`` (sorted as strings),
    ``contaminated``.

    Items without words count as absent; so do null texts.  A null item id takes part with no name.  Rows that repeat an
    id with the same text give the same row each; with different texts each is judged by its own.  Empty tables
    on either side are fine.
    """
    found = hits(docs, benchmark, **options)
    hit = hit_documents(found).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_hit", "items")
    joined = found.sizes.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of ``benchmark``.

    Null and empty texts hold none and stay.  Rows that repeat go or stay together; of rows with the same id, or none, each
    is judged by its own text.  Other columns, whatever their names, pass through.  With an empty table on either side all
    rows stay."""
    found = hits(docs, benchmark, broadcast_bytes=broadcast_bytes, **options).hits
    keys = materialise(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated").alias("hit")
    keys = F.broadcast(keys) if _fits_broadcast(keys, F.lit(16), broadcast_bytes) else keys.hint("shuffle_hash")
    return docs.alias("doc").join(keys, F.col("doc.doc_id").eqNullSafe(F.col("hit._id")) & (F.xxhash64("doc.text") == F.col("hit._hash")), "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s, w FROM b WHERE len(w) > 0),
bx AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM bw),
dp AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS s, w FROM d),
dx AS (SELECT doc_id, s, k.n, array_to_string(w[s:s + k.n - 1], ' ') AS win FROM dp, (SELECT DISTINCT n FROM bx) k WHERE s + k.n - 1 <= len(w)),
h AS (SELECT dx.doc_id, dx.s, dx.n, bx.item_id FROM dx JOIN bx ON dx.n = bx.n AND dx.win = bx.win),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
