"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, resemblance
from .common import bytes_of, by_batch, materialise, unused
from .components import connected_components

#: Rows that are compared with each other at once; larger blocks are compared chunk by chunk.
CHUNK = 1024
#: Shingles hashed at once, which bounds memory for very long texts.
PIECE = 1 << 18
#: Blocks up to this size are compared row against row for all of them at once.
SMALL = 32

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(data: bytes, shingle: int, seed: int) -> int:
    """SimHash of the word shingles of a UTF-8 text, repeats included; 0 if it has no word."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    text = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(shingle, len(tokens)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), PIECE):
        hashes = np.array([digest(text[s:e], seed) for s, e in zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=False)], dtype="<u8")
        each = hashes.view(np.uint8).reshape(-1, 8) + _COLUMN
        ones += (np.bincount(each.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``print`` (the fingerprint as a signed long) for each row of ``docs`` (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, shingle, seed) for x in bytes_of(batch)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(by_batch(run), "doc_id long, print long")


def pigeonhole_blocks(max_bits: int, spare: int) -> list[int]:
    """Bit masks, of which two 64-bit fingerprints within ``max_bits`` agree on at least one.

    The 64 bits are cut into ``max_bits + spare`` blocks; ``max_bits`` differing bits spoil at most as
    many blocks, so some choice of ``spare`` blocks agrees entirely.
    """
    count = max_bits + spare
    cuts = [64 * k // count for k in range(count + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, spare)]


def spare_for(rows: int, max_bits: int) -> int:
    """How many blocks a pair must agree on so that a block of the fingerprint has two bits more than a row number needs: chance
    meetings stay under one a block however many rows there are.  Every choice finds the same pairs."""
    return next(k for k in range(1, 65 - max_bits) if 64 * k / (max_bits + k) >= min(48.0, math.log2(max(2, rows)) + 2))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component, for the graph of edges (a, b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        for at in (x, y, root[x], root[y]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _far(prints: np.ndarray, one: np.ndarray | int, two: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[one] ^ prints[two])


def _search(prints: np.ndarray, low: int, high: int, max_bits: int) -> tuple[list[int], list[int]]:
    """Spanning forest of rows ``low`` to ``high`` under "within max_bits": from each row reached, only rows not reached
    yet are looked at, so a dense block costs little more than one look at each row."""
    left, a, b = np.arange(low, high), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = _far(prints, here, left) <= max_bits
            found = left[near].tolist()
            a += found
            b += [here] * len(found)
            queue += found
            left = left[~near]
    return a, b


def link_blocks(group: np.ndarray, node: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) of nodes that span the links inside each group; rows of a group are neighbours."""
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    size, one, two = np.diff(edges), [], []
    for low, high in zip(edges[:-1][size > SMALL].tolist(), edges[1:][size > SMALL].tolist(), strict=True):
        a, b = _search(prints, low, high, max_bits)
        one.append(np.array(a, np.int64))
        two.append(np.array(b, np.int64))
    at, apart = np.flatnonzero(np.repeat(size <= SMALL, size)), 1
    while True:
        at = at[at + apart < len(group)]
        at = at[group[at] == group[at + apart]]
        if not len(at):
            break
        near = at[_far(prints, at, at + apart) <= max_bits]
        one.append(near)
        two.append(near + apart)
        apart += 1
    if not one:
        return node[:0], node[:0]
    return forest(node[np.concatenate(one)], node[np.concatenate(two)])


def _compare(max_bits: int):
    """Stream over rows sorted by block and link rows of one block; a block left open by a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = np.column_stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            now = now if kept is None else np.concatenate([kept, now])
            new = np.any(now[1:, :3] != now[:-1, :3], axis=1)
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            done, kept = now[:last], now[last:]
            if last:
                yield emit(done, np.concatenate([[0], np.cumsum(new[: last - 1])]))
        if kept is not None and len(kept):
            yield emit(kept, np.zeros(len(kept), np.int64))

    def emit(rows: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        node = np.ascontiguousarray(rows[:, 3])
        a, b = link_blocks(group, node, node.view(np.uint64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def link(prints: DataFrame, masks: list[int], max_bits: int, chunk: int = CHUNK) -> DataFrame:
    """Edges ``a``, ``b`` between different fingerprints, the ``node`` column of ``prints``, that agree on a block and differ in at
    most ``max_bits`` bits: not all of them, but enough that the components are those of all links.

    Blocks of more than ``chunk`` fingerprints are compared by :mod:`blocks`.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("node").bitwiseAND(F.lit(_signed(mask)))) for i, mask in enumerate(masks)])
    rows = prints.select("node", F.explode(keys).alias("block"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    one = F.lit(1).cast("long")
    sizes = materialise(sizes.select("block", blocks.pieces(F.col("n"), one, chunk, chunk).alias("pieces")), "block-sizes")  # a join with a plain table can be split where a block is hot
    members = materialise(rows.join(sizes, "block").select("block", "node", one.alias("terms"), "pieces"), "block-members")  # blocks of one are gone

    def compare(cells: DataFrame) -> DataFrame:
        return cells.select("block", "x", "y", "node").repartition("block", "x", "y").sortWithinPartitions("block", "x", "y").mapInArrow(_compare(max_bits), "a long, b long")

    return blocks.links(members, compare, chunk, chunk)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """``doc_id``, ``print``, ``component_id`` for every row of ``docs`` (doc_id, text; more columns are ignored).

    Two documents are linked if their fingerprints differ in at most ``max_bits`` bits.  Such pairs agree on a pigeonhole
    block; blocks get wider with the number of fingerprints.
    ``component_id`` is the smallest ``doc_id`` reachable over links.  Texts that are null, empty or
    only white space have fingerprint zero and are linked like others.  Rows with a null ``doc_id``
    keep their place but never name a component unless all its ids are null.  Repeated rows give
    repeated results.  An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    classes = materialise(prints.groupBy(F.col("print").alias("node")).agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    masks = pigeonhole_blocks(max_bits, spare_for(classes.count(), max_bits))
    roots = connected_components(link(classes, masks, max_bits))
    rooted = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "roots")
    named = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-names")
    labels = rooted.join(named, "root").select("node", "component_id")
    return prints.join(labels, prints["print"] == labels["node"]).select("doc_id", "print", "component_id")


def distinct_documents(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each group of near duplicates: the first row with the smallest
    id stays.  Near duplicates share ``least`` (a fraction) of their word shingles, which is decided by the sets themselves.
    Rows stand for themselves: of those with the same id, or none, only near duplicates go.  Null ids come last, ties go by
    a hash of the text."""
    found = materialise(resemblance.near_duplicates(docs, shingle, least), "near-duplicates")
    key, rank = unused(docs, "key"), unused(docs, "rank")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias(key)).hint("shuffle_hash")
    rows = docs.withColumn(key, resemblance.row_key()).join(kept, key, "left_semi")  # one partitioning serves the join and the window
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).where(F.col(rank) == 1).select(*docs.columns)
