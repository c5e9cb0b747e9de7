"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration.

Tokens are words.  A word's log-odds of standing in a toxic document are smoothed by a chain of
Dirichlet priors: the prior of a word is the rate of its five-letter prefix, whose prior is the
rate of its four-letter prefix, whose prior is the base rate; so unseen inflections of a known
word inherit what its prefix has shown.  All other words cost a small constant.  One linear scan
per document finds all maximal scoring segments; a segment's score is measured against the
Karlin-Altschul law for background text of the document's length, and what the significant
segments exceed it by is added up and mapped to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Memo, by_batch, materialise, texts_of

#: Labelled rows that the classifier is fitted on at most: those whose hashed id is smallest.
SAMPLE = 20_000
#: Strength of each prior in documents, the significance a log-odds ratio needs, and what any other word costs.
PRIOR, SIGMA, DRIFT = 5.0, 3.0, 0.25
PREFIXES = (4, 5)
THRESHOLD = 0.7

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return text.lower().split()


def parts_of(word: str) -> list[str]:
    """The runs of letters in a white-space-separated word."""
    return _LETTERS.findall(word)


def segments(hits: Sequence[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a sequence in which position i scores ``hits``' value and every other
    position ``-drift``: (score, first, last), in order.  Linear in the number of hits.

    Runs of equal negative scores never need to be visited: cumulative sums jump over them.
    """
    stack: list[list[float]] = []  # left sum, right sum, first, last, index of the nearest earlier one with a smaller left sum
    total, at = 0.0, -1
    for place, value in hits:
        left = total - drift * (place - at - 1)
        total, at = left + value, place
        if value <= 0:
            continue
        now = [left, total, place, place, -1]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= now[0]:
                k = int(stack[k][4])
            if k < 0 or stack[k][1] >= now[1]:
                now[4] = k
                stack.append(now)
                break
            now[0], now[2] = stack[k][0], stack[k][2]
            del stack[k:]
    return [(s[1] - s[0], int(s[2]), int(s[3])) for s in stack]


@dataclass
class Model:
    """Scores of words and prefixes over the drift, the background law, and the map to a probability."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    seen: frozenset[str] = frozenset()
    rate: float = 1.0
    spread: float = 1e-6
    slope: float = 1.0
    offset: float = -3.0

    def score(self, word: str) -> float:
        best = 0.0
        for part in parts_of(word):
            got = self.words.get(part)
            if got is None and part not in self.seen:
                got = next((self.prefixes[part[:n]] for n in reversed(PREFIXES) if len(part) > n and part[:n] in self.prefixes), None)
            best = max(best, got or 0.0)
        return best

    def excess(self, found: Sequence[tuple[float, int, int]], length: int) -> float:
        """By how much the segments exceed what background text of that many words would show."""
        bar = math.log(max(self.spread * length, 1e-9))
        return sum(max(0.0, self.rate * s - bar) for s, _, _ in found)

    def probability(self, excess: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * excess + self.offset))))


class Scorer:
    """Scores texts one after another; remembers which words it has seen, and the scores of those that have one."""

    #: Bytes of words remembered, about, and characters up to which a word is remembered.
    MOST, LONGEST = 32 << 20, 64

    def __init__(self, model: Model):
        self.model, self.known, self.hot, self.held = model, set(), {}, 0

    def __call__(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        words = words_of(text)
        distinct, rare = set(words), {}
        for word in distinct - self.known:
            score = self.model.score(word)
            if len(word) > self.LONGEST:
                rare[word] = score
                continue
            self.known.add(word)
            self.held += len(word) + Memo.ENTRY
            if score:
                self.hot[word] = score
        hot = {w: self.hot[w] for w in distinct & self.hot.keys()} | {w: s for w, s in rare.items() if s}
        if self.held > self.MOST:
            self.known.clear()
            self.held = 0
        return segments([(i, hot[w]) for i, w in enumerate(words) if w in hot]) if hot else [], len(words)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _near_key(text: str) -> int:
    """The least hash of a text's five-word shingles: mostly the same for near copies."""
    words = words_of(text)
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text``, ``toxic`` of at most ``sample`` labelled documents that are not held out; of near copies one stays,
    so that a copied passage does not look like many witnesses.  The ids are few enough to broadcast by that bound."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def key(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([_near_key(x) for x in texts_of(batch)], pa.int64())], [*batch.schema.names, "near"])

    rows = rows.mapInArrow(by_batch(key), "doc_id long, text string, toxic int, near long")
    one = rows.groupBy("near", "toxic").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return materialise(one.select("least.text", "toxic"), "toxicity-training")


#: Distinct terms that a task counts before it hands the counts on; they are added up behind the shuffle.
MOST_TERMS = 1 << 16


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, Counter] = {"bad": Counter(), "good": Counter(), "uses": Counter()}

    def counted() -> pa.RecordBatch:
        names = list(set().union(*totals.values()))
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in totals.values())], ["term", *totals])
        for c in totals.values():
            c.clear()
        return out

    for batch in batches:
        for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
            tokens = [p for w in words_of(text) for p in parts_of(w)]
            kinds = {f"w{t}" for t in tokens} | {f"p{t[:n]}" for t in set(tokens) for n in PREFIXES if len(t) > n} | {"d"}
            totals["bad" if toxic else "good"].update(kinds)
            if not toxic:
                totals["uses"].update(f"w{t}" for t in tokens)
                totals["uses"]["d"] += len(tokens)
            if sum(map(len, totals.values())) > MOST_TERMS:
                yield counted()
    yield counted()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).  What reaches the driver is the terms that
    occur in several toxic training documents, the clean words that begin like them, and a few numbers per training
    document, all bounded by ``sample``.

    An id with labels of both kinds counts as toxic; a repeated id brings each of its texts; null ids and null labels are
    left out, null and empty texts count as clean or toxic without words.  With no labelled row, or only one class, the model
    scores every text alike."""
    rows = training_rows(docs, labels, sample)
    counts = rows.mapInArrow(_count, "term string, bad long, good long, uses long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("bad", "good", "uses")))
    counts = materialise(counts, "toxicity-terms")
    kept = {r["term"]: (r["bad"], r["good"], r["uses"]) for r in counts.where("bad > 1 or term = 'd'").collect()}
    bad, good, uses = kept.pop("d", (0, 0, 0))
    model = Model()
    if not bad or not good:
        return model
    base = bad / (bad + good)

    def smooth(term: str, prior: float) -> tuple[float, float]:
        b, g, _ = kept.get(term, (0, 0, 0))
        p = (b + PRIOR * prior) / (b + g + PRIOR)
        odds = math.log(p / (1 - p)) - math.log(base / (1 - base))
        # The error of a log-odds ratio against the base rate, with the base rate's own pseudo-counts: those of a prior
        # near 1 would make the best witnesses look uncertain.
        return p, odds if odds > SIGMA * math.sqrt(1 / (b + PRIOR * base) + 1 / (g + PRIOR * (1 - base))) else 0.0

    def chain(word: str) -> float:
        p = base
        for n in PREFIXES:
            if len(word) > n:
                p, _ = smooth(f"p{word[:n]}", p)
        return p

    for term in kept:
        name = term[1:]
        if term[0] == "p":
            prior = base
            for n in PREFIXES:
                if n < len(name):
                    prior, _ = smooth(f"p{name[:n]}", prior)
            if odds := smooth(term, prior)[1]:
                model.prefixes[name] = odds
        elif odds := smooth(term, chain(name))[1]:
            model.words[name] = odds
    # A word that clean documents hold is no unseen inflection, whatever its prefix has shown.
    begins = [F.substring("term", 2, n).isin([p for p in model.prefixes if len(p) == n]) & (F.length("term") > n + 1) for n in PREFIXES]
    clean = counts.where((F.substring("term", 1, 1) == "w") & (F.col("bad") <= 1) & (F.col("good") > 1) & (begins[0] | begins[1])).select("term")
    model.seen = frozenset(t[1:] for t in kept if t[0] == "w") | {r[0][1:] for r in clean.collect()}
    # The background law: the rate at which scores of clean words have mean exponential one.
    law = [(s, max(0.5, kept[f"w{w}"][2]) / max(1, uses)) for w, s in model.words.items()]
    share = sum(p for _, p in law) or 1e-9
    low, high = 1e-3, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        mean = sum(p * math.exp(min(600.0, middle * s)) for s, p in law) + (1 - min(0.5, share)) * math.exp(-middle * DRIFT)
        low, high = (low, middle) if mean > 1 else (middle, high)
    model.rate, model.spread = low, share

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            values = [model.excess(*scorer(x)) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), batch.column("toxic")], ["x", "y"])

    points = [(r["x"], r["y"]) for r in rows.mapInArrow(measure, "x double, y int").collect()]
    model.slope, model.offset = _logistic(points)
    return model


def _logistic(points: list[tuple[float, int]], ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset of a logistic curve by damped Newton steps, with a small ridge so that separable points stay finite."""
    a, b = 0.1, -2.0
    for _ in range(100):
        ga, gb, haa, hab, hbb = ridge * a, ridge * b, ridge, 0.0, ridge
        for x, y in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            e, w = p - y, max(p * (1 - p), 1e-9)
            ga, gb, haa, hab, hbb = ga + e * x, gb + e, haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 0.0), b


def scores(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """``docs`` with a column ``to``, instead of any of that name: the probability that the text is toxic.  Null and empty
    texts score what a text without any toxic passage scores.  All other columns pass through untouched; repeated rows and
    null ids give a row each, an empty table an empty result."""
    docs = docs.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            values = [model.probability(model.excess(*scorer(x))) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, to])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(to, DoubleType())]))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``first``, ``last`` (word positions) of every significant passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                found, length = scorer(text)
                out += [(doc_id, *s) for s in found if model.excess([s], length) > 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "score", "first", "last"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, first long, last long")
