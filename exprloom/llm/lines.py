"""Line deduplication: range-partitioned line hashes, streamed first occurrences, keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, by_batch, materialise, unused

#: White space stripped from a line's ends.
BLANKS = b" \t\n\x0b\x0c\r"
LINE_SCHEMA = "h1 long, h2 long, doc_id long, text_hash long, at array<int>"

NAMES = ["h1", "h2", "doc_id", "text_hash", "at"]


def key_of(line: bytes) -> bytes:
    """What two lines must share to count as the same: stripped, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """One row for each document and distinct key of at least ``least`` code points: two hash words of the key
    and the places of its lines.  No text leaves this step."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two, rows, places = [], [], [], []
        for row, data in enumerate(bytes_of(batch)):
            seen: dict[bytes, list[int]] = {}
            for at, line in enumerate(data.split(b"\n")):
                if len(line) >= least and len(key := key_of(line)) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                    seen.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
            for digest, where in seen.items():
                one.append(digest[:8])
                two.append(digest[8:])
                rows.append(row)
                places.append(where)
        words = [pa.array(np.frombuffer(b"".join(x), dtype="<i8")) for x in (one, two)]
        ids = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "text_hash")]
        return pa.RecordBatch.from_arrays([*words, *ids, pa.array(places, pa.list_(pa.int32()))], ["h1", "h2", "doc_id", "text_hash", "at"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(by_batch(run), LINE_SCHEMA)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash and document.  Emits as kind 0 the rows that repeat an earlier document's line; of the
    first hash, which may have begun in an earlier partition, the first document's rows as kind 1; and as kind 2
    the last hash with the first document that has it here.  The last two are a few rows a partition."""
    first = held = None  # the partition's first (hash, document); the open hash and its first document
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        one, two = (np.asarray(batch.column(c)) for c in ("h1", "h2"))
        ids = batch.column("doc_id")
        known = np.asarray(ids.is_valid())
        doc = np.asarray(ids.fill_null(0))
        new = np.ones(n, bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        if held and held[0] == (int(one[0]), int(two[0])):
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        owner = np.where(start >= 0, doc[start], 0 if held is None else held[1] or 0)
        owned = np.where(start >= 0, known[start], held is not None and held[1] is not None)
        again = (doc != owner) | (known != owned)
        kind = np.where(again, 0, -1)
        if first is None:
            first = (int(one[0]), int(two[0]), doc[0], known[0])
        same = (one == first[0]) & (two == first[1]) & (doc == first[2]) & (known == first[3])
        kind[same] = 1
        if (picked := np.flatnonzero(kind >= 0)).size:
            rows = batch.take(pa.array(picked))
            yield pa.RecordBatch.from_arrays([pa.array(kind[picked].astype(np.int32)), *rows.columns], ["kind", *NAMES])
        held = ((int(one[-1]), int(two[-1])), int(owner[-1]) if owned[-1] else None)
    if held:
        last = [pa.array([x], pa.int64()) for x in (*held[0], held[1], 0)]
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), *last, pa.array([[]], pa.list_(pa.int32()))], ["kind", *NAMES])


def repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``doc_id``, ``text_hash``, ``at``: places of the lines to drop, for documents that lose any.

    Rows are dealt by range of (hash, document), so a line that a third of all documents share spreads over many
    tasks; a partition leaves open only whether its very first document is the first of all, which a join with one
    row per partition settles.
    """
    hashes = materialise(line_hashes(docs, least), "line-hashes")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").asc_nulls_last()]
    found = hashes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream, f"kind int, {LINE_SCHEMA}")
    found = materialise(found, "repeated-lines")
    edges = found.where("kind = 2").select("h1", "h2", F.col("doc_id").alias("owner"))
    owners = edges.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
    open_rows = found.where("kind = 1").join(owners, ["h1", "h2"])
    late = open_rows.where(F.col("owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("owner") < F.col("doc_id"))))
    columns = ["doc_id", "text_hash", "at"]
    return found.where("kind = 0").select(*columns).unionAll(late.select(*columns))


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """``doc_id``, ``text_hash``, ``keep`` (compressed bitmap of a text's lines up to the last that is dropped, set where one is
    kept) for the documents of ``docs`` (doc_id, text) that lose a line; all other lines stay."""
    places = repeated_lines(docs, least).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("at")).alias("at"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        maps = []
        for at in batch.column("at"):
            where = np.asarray(at.values)
            bits = np.ones((int(where.max()) // 8 + 1) * 8, np.uint8)  # whole bytes, so that nothing is filled up with zeros
            bits[where] = 0
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(maps, pa.binary())], ["doc_id", "text_hash", "keep"])

    return places.mapInArrow(by_batch(pack), "doc_id long, text_hash long, keep binary")


def kept_lines(data: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """A text's number of lines, how many the bitmap drops, and what is left."""
    lines = data.split(b"\n")
    if not keep:
        return len(lines), 0, data
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)]
    return len(lines), int((bits == 0).sum()), b"\n".join([x for x, b in zip(lines, bits.tolist(), strict=False) if b] + lines[len(bits) :])


def with_bitmaps(docs: DataFrame, least: int, to: str) -> DataFrame:
    """``docs`` with a column ``to``.  Bitmaps are few and small, so they are the hashed side and texts are not sorted."""
    maps = keep_bitmaps(docs.select("doc_id", "text"), least).toDF("_id", "_hash", "_map").hint("shuffle_hash").alias("m")
    same = F.col("d.doc_id").eqNullSafe(F.col("m._id")) & (F.xxhash64("d.text") == F.col("m._hash"))
    return docs.alias("d").join(maps, same, "left").select("d.*", F.col("m._map").alias(to))


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``docs`` (all columns) with ``text`` reduced to the lines that stay.

    A line goes if its key (white space stripped, A-Z lower-cased) has at least ``least`` code points and occurs
    in a document with a smaller ``doc_id``.  Within one document repeats stay.  Null and empty texts are one empty
    line and stay as they are; rows with the same ``doc_id`` count as one document, each with its own text; null ids come after all others
    and count as one document.
    """

    extra = unused(docs, "keep")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for value, keep in zip(batch.column("text"), batch.column(extra), strict=True):
            if not value.is_valid or not keep.is_valid:
                texts.append(value.as_py())
            else:
                texts.append(kept_lines(value.as_buffer().to_pybytes(), keep.as_py())[2].decode("utf-8", "replace"))
        names = [c for c in batch.schema.names if c != extra]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return with_bitmaps(docs, least, extra).mapInArrow(by_batch(run), docs.schema)


def line_report(docs: DataFrame, least: int = 10) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped``, ``kept_sha256`` of each document; see :func:`dedup_lines`."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [kept_lines(data, keep.as_py()) for data, keep in zip(bytes_of(batch), batch.column("keep"), strict=True)]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(docs.select("doc_id", "text"), least, "keep").mapInArrow(by_batch(run), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
r AS (SELECT k.doc_id, k.pos, k.line, coalesce(m.owner < k.doc_id, false) AS gone FROM k LEFT JOIN m ON k.key = m.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
