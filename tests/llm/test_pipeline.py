"""The pipeline and each of its stages against plain versions over all rows in memory."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from exprloom.llm import simhash, toxicity
from tests.llm.conftest import ODD
from tests.llm.test_pairs import alike, hit_report, shingles, text
from tests.llm.test_texts import by_rounds, corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score long, key string, window long, hit string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with every planted case, and the tables beside them."""
    at, rng = tmp_path_factory.mktemp("corpus"), random.Random(41)
    prose, labels = corpus(260, seed=17)
    items = [(k, text(rng, 14, 9000)) for k in range(12)] + [(50, None), (51, "short item")]
    rows = list(prose)
    for k in range(30):  # copies, near copies just above and below the threshold, lines that repeat, passages of items
        words = [f"u{rng.random()}" for _ in range(104)]
        rows += [(1000 + 4 * k, " ".join(words)), (1001 + 4 * k, " ".join(words[:-11] + [f"v{rng.random()}" for _ in range(11)])), (1002 + 4 * k, " ".join(words[:-12] + [f"v{rng.random()}" for _ in range(12)])), (1003 + 4 * k, " ".join(words))]
    rows += [(2000 + k, f"A line that very many documents share\n{text(rng, 20, 9000)}\n  a LINE that very many documents share\t") for k in range(40)]
    rows += [(3000 + k, f"{text(rng, 30, 9000)} {items[k % 12][1].upper()}, {text(rng, 8, 9000)}") for k in range(20)]
    rows += [*ODD, (1000, "quite another text under an id that repeats"), (4000, "long words " * 60_000), (4001, "\n".join(f"line {k} of a long text" for k in range(20_000))), (None, text(rng, 40, 9000))]
    sources = ["web", "books", None, "code"]
    table = [(i, t, "en", sources[(i or 0) % 4], len(t or ""), 7, "k", 3, "h") for i, t in rows]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), items


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_toxicity(spark, rows, folder):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    out = []
    for r in rows:
        words = (r[1] or "").lower().split()
        odds = [model.score(w) for w in words]
        hits = [(i, o) for i, o in enumerate(odds) if o]
        if model.probability(model.excess(toxicity.segments(hits), len(words))) < toxicity.THRESHOLD:
            out.append(r)
    return out


def plain_lines(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))
    rank, owner = lambda i: (i is None, i or 0), {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), r[0]), r[0], key=rank)
    out = []
    for r in rows:
        kept = None if r[1] is None else "\n".join(x for x in r[1].split("\n") if len(key(x)) < 10 or owner[key(x)] == r[0])
        out.append((r[0], kept, *r[2:4], None if kept is None else len(kept), *r[5:]))
    return out


def plain_near_duplicates(rows):
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) * 5 >= max(len(sets[i]), len(sets[j])) * 4 and alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [group for group in groups.values()]


def check_near_duplicates(kept, rows):
    """One row of each group stays, with the smallest id that the group has."""
    left = Counter(kept)
    for group in plain_near_duplicates(rows):
        stay = [r for r in set(group) if left[r]]
        assert len(stay) == 1 and left[stay[0]] == 1
        assert (stay[0][0] is None, stay[0][0] or 0) == min((r[0] is None, r[0] or 0) for r in group)
        del left[stay[0]]
    assert not +left


def plain_clean(rows, items):
    return [r for r in rows if not hit_report([r[:2]], items)[0][5]]


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((hashlib.md5(str(r[0] if r[0] is not None else "").encode()).hexdigest(), r[0] or 0, size(r[1]), r[0]))
    targets, out = by_rounds({s: sum(x[2] for x in own) for s, own in sources.items()}), []
    for s, own in sources.items():
        total, start, budget = sum(x[2] for x in own), 0, math.floor(targets[s] + 1e-9)
        for _, _, n, i in sorted(own):
            out.append((i, n, s, sum(max(0, min(n, budget - start - total * p)) for p in range(2))))
            start += n
    return sorted(out, key=str)


def test_each_stage_equals_its_plain_version(spark, folder):
    where, items = folder
    docs, columns = spark.read.parquet(f"{where}/documents.parquet"), SCHEMA
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        out = stage(spark, docs, where)
        after = rows_of(out)
        if name == "toxicity":
            assert after == sorted(plain_toxicity(spark, before, where), key=str) and len(after) < len(before)
        elif name == "line_dedup":
            assert after == sorted(plain_lines(before), key=str)
        elif name == "near_duplicates":
            check_near_duplicates(after, before)
            assert len(before) - len(after) > 50
        elif name == "decontamination":
            assert after == sorted(plain_clean(before, items), key=str) and len(after) < len(before)
        else:
            assert sorted(((r["doc_id"], r["size"], r["source"], r["taken"]) for r in out.collect()), key=str) == plain_mix(before)
            break
        assert out.columns == docs.columns == [c.split()[0] for c in columns.split(", ")]
        docs = spark.createDataFrame(after, SCHEMA)
    whole = corpus_pipeline.run(spark, where)
    assert sorted(((r["doc_id"], r["size"], r["source"], r["taken"]) for r in whole.collect()), key=str) == plain_mix(before)


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_empty_tables(spark, folder, stage):
    where, _ = folder
    function = corpus_pipeline.STAGES[stage][1]
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert function(spark, docs.where("doc_id > 99999"), where).count() == 0
    odd = docs.where("doc_id < 8 or doc_id is null")
    assert 0 < function(spark, odd, where).count() <= odd.count()


@pytest.mark.parametrize("low", [0.80, 0.85, 0.90, 0.95])
def test_near_duplicates_are_found_in_each_band(frame, low):
    """Pairs whose resemblance lies in a band of 0.05, at lengths from 60 to 500 words, are all found."""
    rng, rows, pairs = random.Random(int(low * 100)), [], 0
    while pairs < 60:
        n = rng.choice([60, 120, 250, 500])
        words = [f"u{rng.random()}" for _ in range(n)]
        copy = list(words)
        for _ in range(rng.randrange(1, 1 + n // 20)):
            copy[rng.randrange(n)] = f"v{rng.random()}"
        a, b = shingles(" ".join(words)), shingles(" ".join(copy))
        if low <= len(a & b) / len(a | b) < low + 0.05 and alike(a, b):
            rows += [(2 * pairs, " ".join(words)), (2 * pairs + 1, " ".join(copy))]
            pairs += 1
    kept = {r["doc_id"] for r in simhash.distinct_documents(frame(rows)).collect()}
    assert kept == {2 * k for k in range(60)}


def test_the_toxic_rows_of_the_corpus_go(spark, folder):
    where, _ = folder
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, where)
    told = labels.where(toxicity.held_out(F.col("doc_id")))
    toxic, clean = told.where("toxic = 1"), told.where("toxic = 0")
    assert kept.join(toxic, "doc_id").count() <= 0.1 * toxic.count()
    assert kept.join(clean, "doc_id").count() >= 0.97 * clean.count()
