"""SimHash, line, suffix and benchmark operators against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from exprloom.llm import components, decontam, lines, resemblance, simhash, suffix
from tests.llm.conftest import ODD


def text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# SimHash.


def exact_fingerprint(t, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_definition():
    rng = random.Random(1)
    for t in [x for _, x in ODD] + [text(rng, n) for n in (1, 3, 4, 5, 60)]:
        assert simhash.fingerprint((t or "").encode(), 4, 42) == exact_fingerprint(t)


def test_blocks_lose_no_pair():
    rng = random.Random(2)
    masks = simhash.pigeonhole_blocks(4, 3)
    assert len(masks) == 35
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 8])
def test_components_equal_brute_force(spark, chunk):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(60):
            near = base
            for bit in rng.sample(range(64), rng.randrange(1, 9)):
                near ^= 1 << bit
            prints.add(near)
    prints = sorted(prints)
    array = np.array(prints, np.uint64)
    edges = [(i, int(j) + i + 1) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[i + 1 :]) <= 4)]
    want = roots(len(prints), edges)
    signed = array.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "node long")
    found = components.connected_components(simhash.link(df, simhash.pigeonhole_blocks(4, 3), 4, chunk))
    label = {r["node"]: r["root"] for r in found.collect()}
    got = {}
    for x, w in zip(signed.tolist(), want, strict=True):
        got.setdefault(label.get(x, x), set()).add(w)
    assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(want))


def test_blocks_widen_with_the_rows():
    assert [simhash.spare_for(n, 4) for n in (0, 1000, 250_000, 15_000_000, 10**10)] == [1, 1, 2, 3, 5]
    for spare in (1, 2, 3, 5):
        masks = simhash.pigeonhole_blocks(4, spare)
        rng = random.Random(spare)
        for _ in range(100):
            flips = sum(1 << bit for bit in rng.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)


def test_near_duplicates_equal_brute_force(frame):
    """From texts to components: fingerprints by definition, all pairs compared, repeats, long texts and empty ones."""
    rng = random.Random(33)
    rows = [(i, text(rng, rng.choice([0, 1, 3, 5, 40, 300]), 60)) for i in range(80)]
    for i in range(60):
        words = rows[i][1].split() * 8 or ["x"]
        words[rng.randrange(len(words))] = f"edit{i}"
        rows += [(1000 + i, " ".join(words)), (2000 + i, rows[i][1] + " end")]
    rows += [*ODD, (5000, text(rng, 300_000, 50)), (4999, rows[3][1]), (5000, "another text")]
    prints = [exact_fingerprint(t) for _, t in rows[:-3]] + [simhash.fingerprint(rows[-3][1].encode(), 4, 42), *(exact_fingerprint(t) for _, t in rows[-2:])]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f, least[r]) for (i, _), f, r in zip(rows, prints, root, strict=True)), key=str)
    got = sorted(((r["doc_id"], r["print"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(frame(rows, print=1)).collect()), key=str)
    assert got == want and len(set(root)) < len(rows) - 40


def test_near_duplicates_on_odd_rows(frame):
    rows = simhash.near_duplicates(frame(ODD, node=1, print=2, component_id=3)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["print"], r["component_id"]))
    assert len(rows) == len(ODD) and by[1] == by[2] == by[3] == {(0, 1)} and by[4] == by[6]
    assert {c for _, c in by[None]} == {1, None}
    assert simhash.near_duplicates(frame(ODD).where("doc_id > 99")).count() == 0


def test_distinct_documents_find_similar_texts(frame):
    rng = random.Random(4)
    rows, groups = [], {}
    for g in range(30):
        words = text(rng, 200, 5000).split()
        for k in range(4):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    docs = frame(rows, key=1, rank=2)
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {groups[i] for i in ids} == set(range(30))
    assert len(ids) <= 36  # copies with up to 15 of 196 shingles changed


def shingles(t, k=5):
    words = (t or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    """Five-word resemblance of at least 0.8; texts without words are alike."""
    return 5 * len(a & b) >= 4 * len(a | b)


def near_pairs(seed=21):
    """Ids and texts in pairs just above and below 0.8, and texts that repeat one phrase but differ in most other words."""
    rng, rows = random.Random(seed), []
    for n, gone in [(104, 11), (104, 12), (204, 22), (204, 23), (49, 5), (49, 6)] * 12:
        words = [f"u{rng.random()}" for _ in range(n)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-gone] + [f"v{rng.random()}" for _ in range(gone)]))]
    for _ in range(6):
        rows.append((len(rows), "one phrase that keeps repeating " * 30 + " ".join(f"u{rng.random()}" for _ in range(80))))
    return rows


def test_near_duplicates_are_decided_by_exact_shingle_sets(frame):
    rows = near_pairs()
    sets = [shingles(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    assert len(edges) == 36
    want = {i for i, r in enumerate(roots(len(rows), edges)) if i == r}
    assert {r["doc_id"] for r in simhash.distinct_documents(frame(rows)).collect()} == want


def test_distinct_documents_keep_rows_of_null_and_repeated_ids(frame):
    rng = random.Random(23)
    a = text(rng, 100, 5000)
    rows = [*ODD, (20, a), (21, a + " end"), (21, "quite another text under the same id"), (21, "quite another text under the same id"), (None, text(rng, 50, 5000)), (None, text(rng, 50, 5000)), (None, a)]
    kept = [(r["doc_id"], r["text"]) for r in simhash.distinct_documents(frame(rows, key=1, row=2, root=3)).collect()]
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if not any(alike(shingles(t), s) for s, _ in first.values()):
            first[i, t] = shingles(t), t
    assert sorted(kept, key=str) == sorted(first, key=str)


@pytest.mark.parametrize("chunk", [resemblance.CHUNK, 8])
def test_resemblance_components_equal_brute_force(frame, chunk):
    rng, rows = random.Random(22), []
    for _ in range(4):
        base = text(rng, 120, 5000).split()
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    found = {r["doc_id"]: r["root"] for r in resemblance.near_duplicates(frame(rows), chunk=chunk).collect()}
    assert len({(found[i], w) for i, w in enumerate(want)}) == len(set(want)) == len(set(found.values()))


def test_no_near_pair_is_lost_to_chance(frame):
    """Nineteen words changed out of 1,600, placed so that each of 32 bands of four least hashes of the first text is spoiled."""
    gone = {37, 138, 146, 158, 270, 276, 283, 310, 337, 349, 381, 499, 587, 627, 741, 851, 902, 934, 961}
    rows = [(1, " ".join(f"w{k}" for k in range(1600))), (2, " ".join(f"x{k}" if k in gone else f"w{k}" for k in range(1600)))]
    assert alike(*(shingles(t) for _, t in rows))
    assert [r["doc_id"] for r in simhash.distinct_documents(frame(rows)).collect()] == [1]


def test_part_fingerprints_are_simhashes():
    rng = np.random.default_rng(3)
    terms = rng.integers(0, 2**64, 30_000, dtype=np.uint64)
    starts = np.unique(np.append(0, rng.integers(0, len(terms), 12_000)))
    found = resemblance.part_fingerprints(terms, starts)
    for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(terms)), strict=True)):
        if k % 50 == 0 or k > len(starts) - 3:
            part = [int(x) for x in terms[a:b]]
            assert int(found[k]) == sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in part) > len(part))


def test_linked_sets_share_blocks_and_pass_the_first_check():
    """Any shingles may differ: also of sets whose hashes lie close together, so that most parts are empty."""
    rng, begins = np.random.default_rng(4), resemblance.levels((4, 5))
    linked = several = 0
    for k in range(3000):
        n, top = int(rng.integers(1, 60 if k % 3 else 400)), 2 ** (64 if k % 5 else 59)
        base, more = (rng.integers(0, top, x, dtype=np.uint64) for x in (n, int(rng.integers(0, n // 4 + 1))))
        a, b = np.unique(base), np.unique(np.append(base[int(rng.integers(0, n // 5 + 1)) :], more))
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both) and a.tobytes() != b.tobytes():
            (x, parts_x, spare_x), (y, parts_y, spare_y) = (resemblance.pigeonhole_blocks(s, (4, 5), begins) for s in (a, b))
            shared, most = set(x.tolist()) & set(y.tolist()), (len(a) + len(b)) // 9
            agree = [sum(key % 2 == odd for key in shared) for odd in (0, 1)]
            assert any(agree[o] and agree[o] >= max(parts_x[o], parts_y[o]) - most for o in (0, 1))
            linked, several = linked + 1, several + (min(*spare_x, *spare_y) <= 0)
    assert linked > 1000 and several > 100


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_meetings_of_blocks_of_all_sizes(step):
    import pyarrow as pa

    rows, want = [], Counter()
    for block, n in [(-9, 1), (-8, 2), (-3, 16), (0, 17), (1, 40), (2, 1), (3, 3), (6, 17)]:
        members = [block * 100 + k for k in range(n)]
        rows += [(block, m) for m in members]
        want.update([(block, m, 2) for m in members] if n > 16 else [(a, b, block % 2) for k, a in enumerate(members) for b in members[k + 1 :]])
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + step]], pa.int64()) for i in (0, 1)], ["block", "node"]) for at in range(0, len(rows), step)]
    got = Counter(tuple(r.values()) for out in resemblance._meet(16)(iter(batches)) for r in out.to_pylist())
    assert got == want


# Lines.


def line_report(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))

    rank = lambda i: (i is None, i or 0)
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), i), i, key=rank)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < 10 or owner[key(x)] == i]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark, frame):
    rng = random.Random(5)
    pool = [f"Line number {k} of the pool" for k in range(30)] + ["short", "", "  "]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) if rng.random() < 0.6 else f"unique {i} {rng.random()}" for _ in range(rng.randrange(9)))) for i in range(300)]
    rows += [(i + 1000, "The Very Common Line\nrest") for i in range(200)] + ODD + [(2000, "a\n" * 5 + "x" * 12), (2001, "X" * 12)]
    got = sorted(map(tuple, lines.line_report(frame(rows, dropped=1, at=2)).collect()), key=str)
    assert got == line_report(rows)
    assert lines.line_report(frame(rows).where("doc_id < -5")).count() == 0


def test_long_texts_lose_their_lines(frame):
    long = "\n".join(f"line {k} of a very long text" for k in range(60_000))
    rows = [(1, long), (2, long + "\nand a line of its own"), (3, "x\n" + long[-3000:])]
    assert sorted(map(tuple, lines.line_report(frame(rows)).collect()), key=str) == line_report(rows)
    maps = lines.keep_bitmaps(frame(rows[:1] + [(2, "own line of two\nline 0 of a very long text\nrest")])).collect()
    assert [np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8), bitorder="little").tolist() for r in maps] == [[1, 0, 1, 1, 1, 1, 1, 1]]


def test_dedup_keeps_other_columns(frame):
    docs = frame([(1, "a line that repeats\nx"), (2, "A Line that repeats \ny"), (3, None)], dropped=7)
    got = {r["doc_id"]: (r["text"], r["dropped"]) for r in lines.dedup_lines(docs).collect()}
    assert got == {1: ("a line that repeats\nx", 7), 2: ("y", 7), 3: (None, 7)}


# Repeated byte strings.


def span_report(rows, window):
    datas = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + window] for _, d in datas for k in range(len(d) - window + 1))
    out = []
    for i, d in datas:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                gone[k : k + window] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(d, np.uint8)[~gone]) if d else b""
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [suffix.MOST_CONTEXTS, 2])
def test_repeats_equal_brute_force(spark, frame, most, monkeypatch):
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (suffix.WINDOW, suffix.GRAM, most))
    rng = random.Random(6)
    passage = text(rng, 60)
    rows = [(i, text(rng, rng.randrange(120))) for i in range(60)]
    rows += [(100 + i, text(rng, 20) + passage[rng.randrange(9) :] + text(rng, 15)) for i in range(40)]
    rows += [(200 + i, rows[i][1]) for i in range(5)] + ODD + [(300, "ab" * 400), (301, "x" * 350), (302, passage + passage), (303, "é" * 150)]
    got = sorted(map(tuple, suffix.report(frame(rows, spans=1, text_hash=2)).collect()), key=str)
    assert got == span_report(rows, 200)


def test_repeats_in_long_texts_and_large_buckets(frame):
    """A text of several pieces, and a passage shorter than a window that very many texts share in different surroundings."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij \n") for _ in range(2 * (1 << suffix.PIECE_BITS) + 5000))
    shared = text(rng, 40)[:150]
    rows = [(1, long), (2, long[(1 << suffix.PIECE_BITS) - 900 : (1 << suffix.PIECE_BITS) + 900]), (3, long[:150] + long[-700:]), (None, long[5000:5300])]
    rows += [(10 + i, f"{text(rng, 12, 9000)} {shared} {text(rng, 12, 9000)}") for i in range(suffix.MOST_CONTEXTS + 200)]
    rows += [(5000 + i, f"same left side of all {'x' * 60} {shared} {text(rng, 15, 9000)}") for i in range(150)]
    got = sorted(map(tuple, suffix.report(frame(rows)).collect()), key=str)
    assert got == span_report(rows, 200)


def test_periodic_texts_make_few_rows(frame):
    rng = random.Random(10)
    rows = [(1, "ab " * 60_000), (2, "ab " * 3000 + "end"), (3, " " * 50_000), (4, "x" + " " * 260), (5, "abc " * 60 + text(rng, 100) + " abc" * 70), (6, "q" * 199), (7, "q" * 200), (8, "z" * 201)]
    docs = frame(rows)
    assert suffix.anchors(docs.withColumn("text_hash", docs["doc_id"]).select("doc_id", "text_hash", "text"), 200, 50).count() < 800
    assert sorted(map(tuple, suffix.report(docs).collect()), key=str) == span_report(rows, 200)


def test_suffix_array_orders_suffixes():
    powers, rng = suffix.Powers(1 << 14), random.Random(7)
    for size, letters in [(1, 1), (40, 1), (300, 2), (900, 4), (700, 256)]:
        data = bytes(rng.randrange(letters) for _ in range(size))
        data += data[: size // 2]
        order = suffix.suffix_array(np.frombuffer(data, np.uint8), 24, powers).tolist()
        assert sorted(order) == list(range(len(data)))
        whole = [data[i : i + 24] for i in order if i + 24 <= len(data)]
        assert whole == sorted(whole)


# Benchmark windows.


def hit_report(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wanted = {}
    for item, t in items:
        w = words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            wanted.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wanted}:
            for k in range(len(w) - size + 1):
                if (at := tuple(w[k : k + size])) in wanted:
                    hit |= set(range(k, k + size))
                    found |= wanted[at]
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_bytes", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_equals_brute_force(spark, frame, broadcast_bytes):
    rng = random.Random(8)
    items = [(k, text(rng, rng.choice([1, 3, 9, 10, 14, 30]), 5000)) for k in range(25)] + [(90, None), (91, " ... "), (3, "ünï Çode"), (92, "common words go here")]
    rows = [(i, text(rng, 60, 5000)) for i in range(60)] + ODD
    rows += [(100 + i, f"{text(rng, 5)}, {items[i % 25][1].upper()}! {text(rng, 9)} Common-words; GO here") for i in range(50)]
    rows += [(200, " ".join(items[5][1].split()[:9])), (201, "x ünï Çode y"), (202, "x ÜNÏ çode")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.report(frame(rows, items=1, words=2, token=3), bench, broadcast_bytes=broadcast_bytes)
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in found.collect()], key=str)
    assert got == hit_report(rows, items)
    kept = sorted((r["doc_id"] for r in decontam.clean(frame(rows, first=9), bench, broadcast_bytes=broadcast_bytes).collect()), key=str)
    assert kept == sorted((r[0] for r in hit_report(rows, items) if not r[5]), key=str)
    assert decontam.report(frame(rows), bench.where("item_id < 0")).where("contaminated").count() == 0


def test_contamination_of_long_and_clashing_rows(spark, frame):
    """Passages at the very end of long texts, windows that many items share, and words that begin or end a text."""
    rng = random.Random(34)
    shared = text(rng, 12, 9000)
    items = [(k, f"{text(rng, 3, 9000)} {shared}") for k in range(60)] + [(70, "... lone!"), (71, shared), (72, "")]
    rows = [(1, text(rng, 120_000, 9000) + " " + shared), (1, "!" + shared + "?"), (2, "lone"), (None, "...lone..."), (3, " ".join(shared.split()[:9])), (4, f"{shared} {shared}"), (4, f"{shared} {shared}"), (5, "é" + shared), (6, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(rows, window=1, shingle=2, anchor=3, first=4, last=5, pos=6)
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in decontam.report(docs, bench).collect()], key=str)
    assert got == hit_report(rows, items)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 6]
