"""Near duplicates by the resemblance of shingle sets: SimHash fingerprints of parts, pigeonhole blocks, Hamming checks, components.

Two sets of sizes a and b share 4/5 of their union exactly if their Hamming distance (shingles in one of them only) is at most
(a + b) / 9.  So the space of shingles is cut into more parts than that distance, and a set has a SimHash fingerprint for each part.
A differing shingle spoils one part; some part of a linked pair is whole, and its fingerprints are equal.  So no pair is missed,
whatever the texts.  A single fingerprint of 64 bits can't promise that: at 0.8 two of them differ in 10 bits on average and any
number may occur.  Pairs that meet are checked twice, by the number of fingerprints that differ and by the sets themselves.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import bytes_of, by_batch, materialise
from .components import connected_components

#: Rows and shingles of a chunk; larger blocks are compared chunk by chunk.
CHUNK, CHUNK_TERMS = 256, 1 << 21
#: Blocks up to this size are written as pairs, which the first check sifts; larger ones are compared as blocks.
SMALL = 16
#: Shingles hashed, and parts fingerprinted, at once.
PIECE, PARTS = 1 << 18, 1 << 13
#: Ways to cut the space, of which sets with too many empty parts use several.
TURNS = 8


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a UTF-8 text; a text of fewer words is one shingle, one of none is empty."""
    tokens = data.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    text = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(shingle, len(tokens)) - 1 :].tolist()
    digest, found = xxhash.xxh64_intdigest, []
    for at in range(0, len(ends), PIECE):
        found.append(np.array([digest(text[s:e]) for s, e in zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=False)], np.uint64))
    return np.unique(np.concatenate(found))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_fingerprints(terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of each part of ``terms``, which begin at ``starts``: a bit is 1 if set in over half the hashes of the part."""
    ends, found = np.append(starts, len(terms)), []
    for at in range(0, len(starts), PARTS):
        cuts = ends[at : at + PARTS + 1]
        bits = np.unpackbits(terms[cuts[0] : cuts[-1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, cuts[:-1] - cuts[0], axis=0, dtype=np.int32)
        found.append(np.packbits(ones * 2 > np.diff(cuts)[:, None], axis=1, bitorder="little").view("<u8").ravel())
    return np.concatenate(found)


def levels(least: tuple[int, int]) -> list[int]:
    """Sizes at which levels begin: sets that may be linked are of one level or of neighbouring ones."""
    up, down = least
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * down // up)))
    return out


def pigeonhole_blocks(terms: np.ndarray, least: tuple[int, int], begins: list[int]) -> tuple[np.ndarray, list[int], list[int]]:
    """Keys of which any two different sets with a resemblance of at least ``least`` share one; for keys that are even and odd, how
    many parts have shingles, and how many more these are than such sets may differ in.

    A set has keys for its own level and for the next.  In the scheme of a level linked sets differ in at most ``most`` shingles,
    so that of over ``most`` parts where one of them has shingles at least one is equal.  Empty parts have no key; a set with too
    few others has keys for a second cut of the space too, and so on: two such sets meet in the first cut that suffices for one."""
    up, down = least
    level, keys, parts, spare = bisect_right(begins, len(terms)) - 1, [np.zeros(0, np.uint64)], [0, 0], [0, 0]
    for scheme in (level, level + 1) if len(terms) else ():
        most = 2 * (begins[scheme + 1] - 1) * (down - up) // (down + up)
        if not most:  # only equal sets are linked
            continue
        count, odd = most + most // 6 + 3, scheme % 2
        for turn in range(TURNS):
            dealt = np.sort(_mix(terms + np.uint64(turn))) if turn else terms
            part = ((dealt >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            place = np.uint64((scheme * TURNS + turn) << 40) + part[starts]
            found = _mix(part_fingerprints(dealt, starts) ^ _mix(place + np.uint64(1)))
            keys.append(found >> np.uint64(1) << np.uint64(1) | np.uint64(odd))
            if not turn:
                parts[odd], spare[odd] = len(starts), len(starts) - most
            if len(starts) > most:
                break
        else:
            keys.append(np.array([2 * scheme + odd], np.uint64))
    return np.concatenate(keys).view(np.int64), parts, spare


def row_key():
    """What tells rows of different ids or texts apart; nulls are values of their own."""
    return F.xxhash64(F.lit("row"), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def sketches(docs: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """For each row its key ``row``, ``doc_id``, ``node`` (hash of the shingle set), ``terms`` (its size) and what
    :func:`pigeonhole_blocks` gives: ``blocks``, ``parts0``, ``parts1``, ``spare0``, ``spare1``."""
    begins, counts = levels(least), ["parts0", "parts1", "spare0", "spare1"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, keys, numbers = [], [], [], []
        for data in bytes_of(batch):
            terms = shingle_set(data, shingle)
            found, parts, spare = pigeonhole_blocks(terms, least, begins)
            nodes.append(xxhash.xxh64_intdigest(terms.tobytes()))
            sizes.append(len(terms))
            keys.append(found)
            numbers.append(parts + spare)
        offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        columns = [batch.column("row"), batch.column("doc_id"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, np.array(numbers, np.int64).T)], ["row", "doc_id", "node", "terms", "blocks", *counts])

    return docs.select(row_key().alias("row"), "doc_id", "text").mapInArrow(by_batch(run), "row long, doc_id long, node long, terms long, blocks array<long>, " + ", ".join(f"{c} long" for c in counts))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(x, shingle).tobytes() for x in bytes_of(batch)], pa.binary())], ["node", "terms"])

    return texts.select("node", "text").mapInArrow(by_batch(run), "node long, terms binary")


def resembling(sets: list[np.ndarray], least: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Spanning forest of ``sets`` under "resemblance at least ``least``" (a fraction), each pair decided by the Hamming distance of
    the sets themselves: from each set reached, only sets not reached yet are looked at."""
    up, down = least
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    held = np.zeros(len(values), bool)
    left, rest, whose, a, b = np.arange(len(sets)), at, owner, [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            here = queue.pop()
            mine = at[ends[here] - sizes[here] : ends[here]]
            held[mine] = True
            both = np.bincount(whose[held[rest]], minlength=len(sets))[left]
            held[mine] = False
            total = sizes[here] + sizes[left]
            near = (total - 2 * both) * (down + up) <= total * (down - up)
            if near.any():
                found = left[near].tolist()
                a += found
                b += [here] * len(found)
                queue += found
                left = left[~near]
                still = np.isin(whose, left)
                rest, whose = rest[still], whose[still]
    return a, b


def _compare(least: tuple[int, int]):
    """Stream over rows sorted by block and link rows of one block; a block may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, nodes, sets = None, [], []

        def links() -> tuple[list[int], list[int]]:
            a, b = resembling(sets, least) if len(sets) > 1 else ([], [])
            return [nodes[i] for i in a], [nodes[i] for i in b]

        for batch in batches:
            one, two = [], []
            keys = zip(*(batch.column(c).to_pylist() for c in ("block", "x", "y")), strict=True)
            for key, node, terms in zip(keys, batch.column("node").to_pylist(), batch.column("terms"), strict=True):
                if key != open_:
                    a, b = links()
                    one += a
                    two += b
                    open_, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(terms.as_buffer().to_pybytes(), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])
        a, b = links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _meet(small: int):
    """Stream over rows sorted by block and node: each pair ``a``, ``b`` of a block of up to ``small`` rows, with ``kind`` 0 or 1 for
    keys that are even or odd; of larger blocks the block ``a`` and node ``b`` of each row, with ``kind`` 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, hot = np.zeros((0, 2), np.int64), None
        for batch in batches:
            now = np.concatenate([kept, np.column_stack([np.asarray(c) for c in batch.columns])])
            if hot is not None:
                same = now[:, 0] == hot
                yield emit([now[same]], [2])
                now = now[~same]
            if not len(now):
                kept = now
                continue
            hot, last = None, int(np.argmax(now[:, 0] == now[-1, 0]))
            done, kept = now[:last], now[last:]
            yield pairs(done)
            if len(kept) > small:
                yield emit([kept], [2])
                hot, kept = int(kept[0, 0]), kept[:0]
        yield pairs(kept)

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        block, node = rows[:, 0], rows[:, 1]
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(rows) else np.zeros(1, np.int64)
        size = np.diff(edges)
        large = np.repeat(size > small, size)
        out, kinds, at = [rows[large]], [2], np.flatnonzero(~large)
        for apart in range(1, small):
            at = at[at + apart < len(rows)]
            at = at[block[at] == block[at + apart]]
            for odd in (0, 1):
                here = at[block[at] & 1 == odd]
                out.append(np.column_stack([node[here], node[here + apart]]))
                kinds.append(odd)
        return emit(out, kinds)

    def emit(rows: list[np.ndarray], kinds: list[int]) -> pa.RecordBatch:
        table, kind = np.concatenate(rows), np.repeat(np.array(kinds, np.int32), [len(x) for x in rows])
        return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1]), pa.array(kind)], ["a", "b", "kind"])

    return run


def candidates(prints: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a``, ``b`` of nodes that met in a small block and pass the first check, and the rows (block, node) of large blocks.

    The check: of the parts of a set in small blocks at least as many agree as are left when the set's greatest Hamming distance from
    the other is taken off.  A set that has enough parts in small blocks to meet all its like there leaves the large ones, which so
    hold dense groups, and not the many sets that share one frequent passage."""
    up, down = least
    rows = prints.select("node", "blocks").distinct().select("node", F.explode("blocks").alias("block"))
    order = Window.partitionBy("block").orderBy("node")
    rows = rows.select("block", "node", F.lag("node").over(order).alias("before"), F.lead("node").over(order).alias("after"))
    rows = rows.where("before is not null or after is not null").select("block", "node")  # blocks of one are gone
    met = materialise(rows.mapInArrow(_meet(SMALL), "a long, b long, kind int"), "meetings")
    large = met.where("kind = 2").select(F.col("a").alias("block"), F.col("b").alias("node"), F.col("a").bitwiseAND(F.lit(1)).alias("odd"))
    held = large.groupBy("node").agg(F.sum(1 - F.col("odd")).alias("large0"), F.sum("odd").alias("large1"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("large0", "large1")]
    nodes = materialise(nodes.join(held, "node", "left").select("node", "terms", "parts0", "parts1", "spare0", "spare1", *zero), "node-parts")
    of = lambda name: F.when(F.col("odd") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    large = large.join(nodes, "node").where(of("spare") <= of("large")).select("block", "node")
    ends = [nodes.select(F.col("node").alias(c), F.col("terms").alias(f"terms_{c}"), *[(F.col(f"parts{k}") - F.col(f"large{k}")).alias(f"{c}{k}") for k in (0, 1)]) for c in "ab"]
    pairs = met.where("kind < 2").groupBy("a", "b").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(f"agree{k}") for k in (0, 1)])
    pairs = pairs.join(ends[0], "a").join(ends[1], "b")
    apart = F.floor((F.col("terms_a") + F.col("terms_b")) * (down - up) / (down + up))
    passed = [(F.col(f"agree{k}") > 0) & (F.col(f"agree{k}") >= F.greatest(f"a{k}", f"b{k}") - apart) for k in (0, 1)]
    return pairs.where(F.least("terms_a", "terms_b") * down >= F.greatest("terms_a", "terms_b") * up).where(passed[0] | passed[1]).select("a", "b"), large


def link(prints: DataFrame, docs: DataFrame, shingle: int, least: tuple[int, int], chunk: int = CHUNK) -> DataFrame:
    """Edges ``a``, ``b`` between different nodes of ``prints`` that resemble each other: not all of them, but enough that the
    components are those of all such links.

    Candidate pairs that hang together are compared as one block.  Blocks of the same members are compared once, blocks over the size
    of a chunk by :mod:`blocks`.  Only the texts of rows in blocks are read again.
    """
    nodes = prints.groupBy("node").agg(*[F.min(c).alias(c) for c in ("row", "terms", "parts0", "parts1", "spare0", "spare1")])
    nodes = materialise(nodes, "nodes")
    pairs, large = candidates(prints, nodes, least)
    groups = materialise(connected_components(pairs), "groups").select("node", "root")
    groups = groups.unionAll(groups.select(F.col("root").alias("node"), "root").distinct())
    rows = large.unionAll(groups.select(F.xxhash64(F.lit("group"), "root").alias("block"), "node"))
    rows = materialise(rows.join(nodes, "node").select("block", "node", "terms"), "block-rows")
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"), F.sum("terms").alias("terms"), F.bit_xor("node").alias("one"), F.bit_xor(F.xxhash64("node")).alias("two")).where("n > 1")
    sizes = sizes.groupBy("n", "terms", "one", "two").agg(F.min("block").alias("block")).select("block", blocks.pieces(F.col("n"), F.col("terms"), chunk, CHUNK_TERMS).alias("pieces"))
    sizes = materialise(sizes, "block-sizes")  # a join with a plain table can be split where a block is hot
    members = materialise(rows.join(sizes, "block").select("block", "node", "terms", "pieces"), "block-members")
    wanted = nodes.select("node", "row").join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.select(row_key().alias("row"), "text").join(materialise(wanted, "block-nodes"), "row").select("node", "text").distinct()
    sets = materialise(_sets(texts, shingle), "block-sets")

    def compare(cells: DataFrame) -> DataFrame:
        met = cells.join(sets, "node").select("block", "x", "y", "node", "terms")
        return met.repartition("block", "x", "y").sortWithinPartitions("block", "x", "y").mapInArrow(_compare(least), "a long, b long")

    return blocks.links(members, compare, chunk, CHUNK_TERMS)


def near_duplicates(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = (4, 5), chunk: int = CHUNK) -> DataFrame:
    """``row``, ``doc_id``, ``root`` for every row of ``docs`` (doc_id, text; more columns are ignored): rows share a root if links
    of a resemblance of at least ``least`` lead from one to the other.  Texts without words resemble each other only."""
    prints = materialise(sketches(docs, shingle, least), "sketches")
    roots = materialise(connected_components(link(prints, docs, shingle, least, chunk)), "roots")
    return prints.select("row", "doc_id", "node").join(roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("root"))
