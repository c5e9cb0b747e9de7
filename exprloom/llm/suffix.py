"""Exact removal of repeated byte strings by suffix sorting of content-defined buckets.

1. Every window of ``WINDOW`` bytes is assigned to the least hashed gram inside it (winnowing).  Equal windows choose
   equal grams, so equal windows meet in one bucket, and a run of windows that share a gram is one context.
2. Buckets with one context are done: nothing in them repeats.  Contexts that are equal as a whole, by a 64-bit hash
   of their bytes besides the 64-bit hash of their gram, repeat as a whole, and one stands for all.
3. The different contexts of a bucket are concatenated and suffix-sorted in two stages: suffixes smaller than their
   successors are sorted directly, the others are induced by scans over the first-byte buckets; windows whose
   neighbour in the suffix array shares ``WINDOW`` bytes with them repeat.
4. A bucket of very many different contexts is divided first.  Equal windows hold the gram at the same place, so windows
   are halved by that place, and what all windows of a half have in common is a longer gram: its hash names the new
   bucket.  The parts go through steps 2 to 4 again; after log2(WINDOW) halvings a part is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, by_batch, materialise

WINDOW, GRAM = 200, 50
#: Window starts handled at once, bytes sorted at once, and contexts up to which a bucket is sorted in one task.
PIECE_BITS, SORT_BYTES, MOST_CONTEXTS = 18, 1 << 20, 2000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, and hashes of substrings from them."""

    def __init__(self, size: int):
        self.up = np.ones(size, np.uint64)
        self.up[1:] = _ODD
        self.up = np.multiply.accumulate(self.up)
        inverse = pow(int(_ODD), -1, 1 << 64)
        self.down = np.ones(size, np.uint64)
        self.down[1:] = np.uint64(inverse)
        self.down = np.multiply.accumulate(self.down)

    def hashes(self, data: np.ndarray, length: int) -> np.ndarray:
        """Hash of ``data[i:i + length]`` for every i that has so many bytes."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        out = (sums[length:] - sums[:-length]) * self.down[: len(data) - length + 1]
        out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
        return out


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def contexts(data: bytes, powers: Powers, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of a text: gram hash, first window, number of windows, place of the gram.  Each window start is in exactly
    one."""
    whole = np.frombuffer(data, np.uint8)
    total, width, piece = len(whole) - window + 1, window - gram + 1, (1 << PIECE_BITS) - window
    mask, out = np.uint64((1 << PIECE_BITS) - 1), []
    for at in range(0, max(0, total), piece):
        part = whole[at : min(at + piece, total) + window - 1]
        grams = powers.hashes(part, gram)
        place = np.arange(len(grams), dtype=np.uint64)
        least = (_sliding_least((grams & ~mask) | place, width) & mask).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        out.append((grams[least[starts]], starts + at, np.diff(np.concatenate([starts, [len(least)]])), least[starts] + at))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(data: np.ndarray, depth: int, powers: Powers) -> np.ndarray:
    """Positions of ``data`` in the order of their suffixes, as far as the first ``depth`` bytes tell (two-stage sorting).

    Suffixes smaller than their successor (type S) are sorted directly, 8 bytes at a time; of suffixes with equal
    hashes over ``depth`` bytes one stands for all.  The others (type L) follow from a scan in order: each sorted
    suffix puts the suffix that begins one byte earlier at the next free place of its first byte's bucket.
    """
    n = len(data)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1].astype(np.int16))
    moves = np.flatnonzero(step)
    smaller = step[moves[np.searchsorted(moves, np.arange(n))]] > 0
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    word = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(word)]
    equal = powers.hashes(padded[: n + depth - 1], depth)
    direct = _sort_direct(np.flatnonzero(smaller), word, equal, depth)
    cuts = np.searchsorted(data[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[data[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        large, rest = [], pending[byte]
        while rest:
            now = np.concatenate(rest)
            large.append(now)
            before = now[now > 0] - 1
            before = before[(data[before] == byte) & ~smaller[before]]
            rest = [before] if len(before) else []
        done = np.concatenate([*large, direct[cuts[byte] : cuts[byte + 1]]])
        if not len(done):
            continue
        out.append(done)
        before = done[done > 0] - 1
        before = before[(data[before] > byte) & ~smaller[before]]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                pending[first[a]].append(before[a:b])
    return np.concatenate(out)


def _sort_direct(places: np.ndarray, word: np.ndarray, equal: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the bytes that begin there."""
    if not len(places):
        return places
    heads, of = np.unique(equal[places], return_inverse=True)
    chosen = np.zeros(len(heads), np.int64)
    chosen[of[::-1]] = places[::-1]
    order = np.argsort(word[chosen], kind="stable")
    keys = word[chosen[order]]
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    at, live = 8, np.arange(len(chosen))
    while at < depth:
        twins = np.zeros(len(live), bool)
        same = group[live][1:] == group[live][:-1]
        twins[1:] |= same
        twins[:-1] |= same
        live = live[twins]
        if not len(live):
            break
        keys = word[chosen[order[live]] + at]
        new = np.lexsort((keys, group[live]))
        order[live] = order[live][new]
        keys, old = keys[new], group[live]
        fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (keys[1:] != keys[:-1])])
        group[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))] + len(chosen)
        at += 8
    rank = np.zeros(len(chosen), np.int64)
    rank[order] = np.arange(len(chosen))
    return places[np.argsort(rank[of], kind="stable")]


def repeated_windows(data: np.ndarray, eligible: np.ndarray, window: int, powers: Powers) -> np.ndarray:
    """For each position whether its window equals that of another eligible position: neighbours in the suffix array
    with a common prefix of ``window`` bytes."""
    order = suffix_array(data, window, powers)
    order = order[eligible[order]]
    one, two = order[:-1], order[1:]
    alike = np.ones(len(one), bool)
    for k in range(0, window, 8):
        live = np.flatnonzero(alike)
        if not len(live):
            break
        far = min(8, window - k)
        differs = np.zeros(len(live), bool)
        for j in range(k, k + far):
            differs |= data[one[live] + j] != data[two[live] + j]
        alike[live[differs]] = False
    out = np.zeros(len(data), bool)
    out[one[alike]] = True
    out[two[alike]] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


#: A context: its bucket ``h``, a hash ``c`` of its bytes, its text, its first window, how many it has, where its gram is, and how
#: many equal contexts follow one upon the other from there, as in periodic text.
CONTEXT = "h long, c long, doc_id long, text_hash long, at int, n int, g int, times int"


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row a context, or a run of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, digest = Powers(1 << PIECE_BITS), xxhash.xxh3_64_intdigest
        for batch in batches:
            parts = []
            for row, data in enumerate(bytes_of(batch)):
                if len(data) >= window:
                    h, at, n, g = contexts(data, powers, window, gram)
                    c = np.array([digest(data[a:b]) for a, b in zip(at.tolist(), (at + n + window - 1).tolist(), strict=True)], np.uint64)
                    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])]))
                    times = np.diff(np.append(first, len(h)))
                    parts.append((h[first].view(np.int64), c[first].view(np.int64), np.full(len(first), row), *(x[first].astype(np.int32) for x in (at, n, g)), times.astype(np.int32)))
            if parts:
                h, c, row, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
                row = pa.array(row)
                arrays = [pa.array(h), pa.array(c), batch.column("doc_id").take(row), batch.column("text_hash").take(row), *map(pa.array, rest)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in CONTEXT.split(", ")])

    return docs.mapInArrow(run, CONTEXT)


#: A context with its bytes: ``single`` if no other is equal to it as a whole, and whether its bucket is to be divided.
PIECE = "h long, doc_id long, text_hash long, at int, n int, g int, single boolean, hot boolean, bytes binary"


def _cut_out(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of the contexts in ``wanted``."""
    fields = ["h", "at", "n", "g", "single", "hot"]
    lists = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct(*fields)).alias("wanted")).hint("shuffle_hash")
    joined = docs.join(lists, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["text_hash"] == F.col("_hash"))).select("doc_id", "text_hash", "text", "wanted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted = batch.column("wanted")
        of, rows = wanted.flatten(), np.repeat(np.arange(batch.num_rows), np.asarray(wanted.value_lengths().fill_null(0)))
        column = {f: of.field(k) for k, f in enumerate(fields)}
        at, ends = column["at"].to_pylist(), (np.asarray(column["at"]) + np.asarray(column["n"]) + window - 1).tolist()
        texts = list(bytes_of(batch))
        data = pa.array([texts[r][a:b] for r, a, b in zip(rows.tolist(), at, ends, strict=True)], pa.binary())
        rows = pa.array(rows)
        column |= {"doc_id": batch.column("doc_id").take(rows), "text_hash": batch.column("text_hash").take(rows), "bytes": data}
        names = [x.split()[0] for x in PIECE.split(", ")]
        return pa.RecordBatch.from_arrays([column[x] for x in names], names)

    return joined.mapInArrow(by_batch(run), PIECE)


def _halves(low: int, high: int, window: int, gram: int):
    """Divide contexts whose windows hold their gram ``low`` to ``high`` bytes from the start: of each a part for the windows of
    either half, in the bucket that the bytes common to all such windows name."""
    middle = (low + high) // 2

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest, rows, out = xxhash.xxh3_64_intdigest, [], {x: [] for x in ("h", "c", "at", "n", "bytes")}
        columns = [batch.column(x).to_pylist() for x in ("h", "at", "n", "g")]
        for row, (h, at, n, g, data) in enumerate(zip(*columns, bytes_of(batch, "bytes"), strict=True)):
            for a, b in ((low, middle), (middle + 1, high)):
                near, far = max(a, g - at - n + 1), min(b, g - at)
                if a <= b and near <= far:
                    part = data[g - far - at : g - near - at + window]
                    shared = data[g - a - at : g - b - at + window]
                    out["h"].append(digest(b"%d %d %d " % (h, a, b) + shared))
                    out["c"].append(digest(b"%d %d " % (near, far) + part))
                    out["at"].append(g - far)
                    out["n"].append(far - near + 1)
                    out["bytes"].append(part)
                    rows.append(row)
        rows, signed = pa.array(rows, pa.int64()), lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        kept = {x: batch.column(x).take(rows) for x in ("doc_id", "text_hash", "g", "single")}
        arrays = [signed(out["h"]), signed(out["c"]), kept["doc_id"], kept["text_hash"], pa.array(out["at"], pa.int32()), pa.array(out["n"], pa.int32()), kept["g"], pa.array(np.ones(len(rows), np.int32)), kept["single"], pa.array(out["bytes"], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PART.split(", ")])

    return run


PART = f"{CONTEXT}, single boolean, bytes binary"

SPAN = "doc_id long, text_hash long, first int, last int"


def _sorted_buckets(window: int):
    """Stream over contexts sorted by gram: sort the suffixes of as many whole buckets as fit, emit repeated spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(SORT_BYTES * 2 + (1 << 20))
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                held.append(batch.slice(at, 1024))
                if sum(b.column("bytes").nbytes for b in held) >= SORT_BYTES:
                    table = pa.Table.from_batches(held).combine_chunks()
                    h = table.column("h").to_numpy()
                    last = int(np.searchsorted(h, h[-1]))  # the open bucket waits for its rest
                    if last:
                        yield from solve(table.slice(0, last), powers)
                        held = table.slice(last).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held), powers)

    def solve(table: pa.Table, powers: Powers) -> Iterator[pa.RecordBatch]:
        texts = table.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data) + 2 * window > len(powers.up):
            powers = Powers(len(data) + 4 * window)
        n, at = table.column("n").to_numpy(), table.column("at").to_numpy()
        begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])[:-1]]).astype(np.int64)
        edge = np.zeros(len(data) + 1, np.int32)
        edge[begin] += 1
        edge[begin + n] -= 1
        found = repeated_windows(data, np.cumsum(edge[:-1]) > 0, window, powers)
        rows, first, last = [], [], []
        for k in np.flatnonzero(table.column("single").to_numpy(zero_copy_only=False)).tolist():
            a, b = _runs(found[begin[k] : begin[k] + n[k]])
            rows += [k] * len(a)
            first += (a + at[k]).tolist()
            last += (b + at[k] + window - 1).tolist()
        rows = pa.array(rows, pa.int64())
        columns = [table.column(c).take(rows).combine_chunks() for c in ("doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["doc_id", "text_hash", "first", "last"])

    return run


def _settle(rows: DataFrame, window: int, most_contexts: int | None) -> tuple[DataFrame, DataFrame]:
    """Spans of contexts that are equal to others as a whole, and one of each kind for the buckets that hold several kinds;
    those of more than ``most_contexts`` are ``hot``, to be divided.

    What is joined back is written first: a join of plain tables can be split where a bucket is hot."""
    carried = [x for x in rows.columns if x not in ("h", "c", "times")]
    kinds = materialise(rows.groupBy("h", "c").agg(F.sum("times").alias("copies"), F.min(F.struct(*carried)).alias("one")), "context-kinds")
    whole = rows.where("single").join(kinds.where("copies > 1").select("h", "c"), ["h", "c"])
    spans = whole.select("doc_id", "text_hash", F.col("at").alias("first"), (F.col("at") + F.col("n") * F.col("times") + window - 1).alias("last"))
    buckets = materialise(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "buckets")
    single = (F.col("copies") == 1) & F.col("one.single")
    wanted = kinds.join(buckets, "h").select("h", *[F.col(f"one.{x}") for x in carried if x != "single"], single.alias("single"), (F.lit(False) if most_contexts is None else F.col("kinds") > most_contexts).alias("hot"))
    return spans, wanted


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``first``, ``last`` (bytes, last exclusive): spans that cover exactly the bytes of windows that
    also start elsewhere, in this document or another.  ``docs`` has doc_id, text_hash, text."""
    every = materialise(anchors(docs, window, gram), "contexts")
    busy = materialise(every.groupBy("h").agg(F.sum("times").alias("seen")).where("seen > 1").select("h"), "busy-grams")
    shared = materialise(every.join(busy, "h").withColumn("single", F.lit(True)), "shared-contexts")
    spans, wanted = _settle(shared, window, most_contexts)
    pieces = materialise(_cut_out(docs, wanted, window), "context-bytes")
    sort = lambda rows: rows.where("not hot").drop("hot", "g").repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_buckets(window), SPAN)
    spans, parts = spans.unionAll(sort(pieces)), [(pieces, 0, window - gram)]
    while parts:
        rows, low, high = parts.pop()
        rows = rows.where("hot").drop("hot")
        if rows.isEmpty():
            continue
        middle = (low + high) // 2
        halves = materialise(rows.mapInArrow(by_batch(_halves(low, high, window, gram)), PART), "context-parts")
        for a, b in ((low, middle), (middle + 1, high)):
            # The place of the gram in a part's first window tells its half.
            mine = halves.where(F.col("g") - F.col("at") <= middle if a == low else F.col("g") - F.col("at") > middle)
            found, wanted = _settle(mine, window, most_contexts if a < b else None)
            wanted = materialise(wanted, "part-bytes")
            spans = spans.unionAll(found).unionAll(sort(wanted))
            parts.append((wanted, a, b))
    return materialise(spans, "spans")


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the spans, how many bytes went, and in how many maximal runs."""
    kept, runs, gone, end = [], 0, 0, 0
    reach = -1
    for first, last in sorted(spans):
        if first > reach:
            runs += 1
            kept.append(data[max(end, 0) : first])
            gone += last - first
            reach = end = last
        elif last > reach:
            gone += last - reach
            reach = end = last
    kept.append(data[end:])
    return b"".join(kept), gone, runs


def with_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the column ``spans``: what to remove from each text (null: nothing)."""
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    found = repeated_spans(keyed.select("doc_id", "text_hash", "text"), window, gram)
    lists = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("first", "last")).alias("spans")).hint("shuffle_hash")
    return keyed.join(lists, keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["text_hash"] == F.col("_hash")), "left").drop("_id", "_hash", "text_hash")


def report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; more columns are ignored): ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256``.

    Removed is each byte covered by a ``window``-byte string that also starts anywhere else.  Null is the empty text; texts
    shorter than ``window`` lose nothing.  Rows that repeat are documents of their own and so repeat each other.
    Null ids are fine.  An empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data, spans in zip(bytes_of(batch), batch.column("spans").to_pylist(), strict=True):
            kept, gone, runs = kept_bytes(data, [(s["first"], s["last"]) for s in spans or ()])
            out.append((len(data), gone, runs, hashlib.sha256(kept).hexdigest()))
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs.select("doc_id", "text"), window, gram).mapInArrow(by_batch(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, (2 * i + 1)::BIGINT, 400)) AS m FROM (SELECT r, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS i FROM d)),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT r, i, i > lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) + 200 AS fresh FROM w SEMI JOIN t USING (m)),
g AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM s),
u AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run),
k AS (SELECT u.r, u.a, u.b, substr(h, (2 * lag(b, 1, 0) OVER p + 1)::BIGINT, (2 * (a - lag(b, 1, 0) OVER p))::BIGINT) AS piece FROM u JOIN d USING (r) WINDOW p AS (PARTITION BY u.r ORDER BY u.a)),
n AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS head FROM k GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN n USING (r)
"""
