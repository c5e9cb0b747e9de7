"""Mixing, fingerprints, tokens, pages, quality, toxicity and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from exprloom.llm import common, cws, html, mixing, quality, tokens, toxicity
from tests.llm.conftest import ODD

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# Mixing.


def by_rounds(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


def test_mix(spark, frame):
    rng = random.Random(1)
    sources = ["b", "a", None, "é", "Z", "aa", "c"]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40)))) for i in range(400)] + ODD
    name = lambda i: sources[0 if (i or 0) % 3 else (i or 0) % 7]
    docs = frame(rows, source=name, size=1, target=2)
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    want = by_rounds(sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert all(0 <= p <= 1 for p in r["positions"])
    assert all(abs(taken[s] - want[s]) < 1 + 1e-6 for s in sizes)
    first = [r["positions"][0] if r["positions"] else 2 for r in got]
    assert first == sorted(first)
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0
    assert {r["target"] for r in mixing.mix(docs.where("doc_id <= 3").withColumn("text", docs["text"].substr(1, 0))).collect()} == {0.0}


def test_mix_of_long_and_repeated_rows(frame):
    rows = [(1, "word " * 400_000), (1, "word " * 400_000), (2, "a b"), (2, "another text"), (None, "x y z"), (None, None), (3, "")]
    got = mixing.mix(frame(rows, source=lambda i: "s", position=1, start=2)).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 3, 400_000, 400_000]
    assert sum(r["taken"] for r in got) == math.floor(got[0]["target"]) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(rows[::-1], source=lambda i: "s")).collect()))


def test_schedules_are_inverted(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("d"))
    for name, knots in mixing.SCHEDULES.items():
        rows = df.select("d", mixing.progress(F.col("d"), F.lit(name), mixing.SCHEDULES).alias("t")).collect()
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        for r in rows:
            area = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                t = min(max(r["t"], t0), t1)
                area += (t - t0) * (w0 + w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / 2
            assert abs(area / whole - r["d"]) < 1e-9


# Fingerprints.


def test_fingerprints(spark, frame, monkeypatch):
    monkeypatch.setattr(cws, "BUCKET", 7)
    rng = random.Random(2)
    rows = [(i * 3, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 90)))) for i in range(60)]
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "x"), (504, "Ünïcode \U0001f600 text")]
    got = sorted(cws.report(frame(rows, bucket=1, slot=2, row=3)).collect())
    likeness = lambda a, b: (lambda x, y: sum((x & y).values()) / max(1, sum((x | y).values())))(Counter(a.lower().split()), Counter(b.lower().split()))
    assert len(got) == len(rows)
    errors = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited, r = t[: len(t) - half] + after[:half], got[k]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        if t.strip() and edited.strip():
            errors.append(r["near_edited"] - likeness(t, edited))
            if after.strip():
                errors.append(r["near_next"] - likeness(t, after))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3
    assert got[0]["signature"] == got[60]["signature"] and got[61]["near_edited"] == 1.0
    odd = cws.report(frame(ODD)).collect()
    assert len(odd) == len(ODD) and all(0 <= r["near_next"] <= 1 for r in odd)
    assert cws.report(frame(ODD).where("doc_id > 99")).count() == 0


def generalised_jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


@pytest.mark.parametrize("own", [500, 5000, 15000])
def test_collision_rate_is_generalised_jaccard(frame, own):
    """Texts of ``own`` distinct words, a fifth of them shared and some of those heavier on one side."""
    rng, rows = random.Random(own), []
    for k in range(16 if own > 5000 else 48):
        shared = [f"s{k}x{j}" for j in range(own // 5)]
        left = shared + [f"l{k}x{j}" for j in range(own - own // 5)] + [w for w in shared if rng.random() < 0.3] * 2
        right = shared + [f"r{k}x{j}" for j in range(own - own // 5)] + [w for w in shared if rng.random() < 0.3]
        rows += [(2 * k, " ".join(left)), (2 * k + 1, " ".join(right))]
    got = {r["doc_id"]: r["signature"] for r in cws.fingerprints(frame(rows), samples=128).collect()}
    apart = [sum(x == y for x, y in zip(got[2 * k], got[2 * k + 1])) / 128 - generalised_jaccard(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(len(rows) // 2)]
    assert abs(sum(apart) / len(apart)) < 0.02


def test_fingerprints_of_long_texts(frame):
    rng = random.Random(37)
    long = " ".join(f"w{rng.randrange(30_000)}" for _ in range(200_000))
    rows = [(1, long), (2, long), (3, long[: len(long) // 2]), (3, "short"), (4, "")]
    got = sorted(cws.report(frame(rows, place=1, edited=2)).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    assert got[0]["near_next"] == 1.0 and got[0]["near_edited"] > 0.5 and got[0]["signature"] == got[1]["signature"]
    assert abs(sum(x == y for x, y in zip(got[1]["signature"], got[3]["signature"])) / 64 - generalised_jaccard(long, long[: len(long) // 2])) < 0.25
    edited = long[: len(long) - len(long) // 2] + long[: len(long) // 2]
    assert got[0]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_null_ids_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(cws, "BUCKET", 20)
    rows = [(None if i % 3 else i, f"text {i % 250} of many words") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = docs.select("doc_id", "text", cws.place(F.col("doc_id"), F.col("text")).alias("place"))
    sizes = Counter(r["bucket"] for r in cws._dealt(placed).where("ghost = 0").collect())
    assert len(sizes) > 10 and max(sizes.values()) < 200
    got = cws.report(docs).collect()
    assert len(got) == 600
    order = sorted(placed.collect(), key=lambda r: r["place"])
    want = Counter()
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        half = len(r["text"]) // 2
        want[r["doc_id"], hashlib.sha256((r["text"][: len(r["text"]) - half] + after["text"][:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


# Tokens.


def test_tokens_equal_the_library(frame):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(VOCABULARY), random.Random(3)
    texts = [t for _, t in ODD] + ["a<|endoftext|>b x", "it's 'S I'M don't 'll", "İstanbul ΣΑΣ á e ́x", "\x1c a\x85b", "x" * 700 + " y " + "ab" * 400, "é" * 1000, "a b c" * 100, "<|startoftext|>" * 60, "\x00\x01 b"]
    texts += ["".join(rng.choice("abXYZ'éß中 \n\t.,!19😀’") for _ in range(rng.randrange(900))) for _ in range(60)]
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    small, plain = tokens.Counter(VOCABULARY, 120, 4), tokens.Counter(VOCABULARY)
    assert [plain.count((t or "").encode()) for t in texts] == want
    assert [small.count((t or "").encode()) for t in texts] == want
    got = tokens.token_counts(frame(list(enumerate(texts)), n_tokens=5), VOCABULARY, limit=50).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {i: (len((t or "").encode()), w, w > 50) for i, (t, w) in enumerate(zip(texts, want, strict=True))}


def test_texts_without_spaces_are_counted_in_bounded_time():
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(VOCABULARY), random.Random(13)
    texts = ["".join(rng.choice("中文字符天地玄黄") for _ in range(30_000)), "".join(rng.choice("abcdefXYZ0123456789+/") for _ in range(60_000)), "x" * 20_000, "ab-cd." * 9000, "é1" * 9000, "'s't" * 9000, "<|endoftext|>" * 3000, "9" * 20_000]
    small = tokens.Counter(VOCABULARY, 1000, 16)
    read = [0]
    plain = small.starts
    small.starts = lambda text, first, last: read.__setitem__(0, read[0] + last - first) or plain(text, first, last)
    for text in texts:
        read[0] = 0
        assert small.count(text.encode()) == len(lib.encode(text, add_special_tokens=False).ids)
        assert read[0] < 16 * len(text)


def test_memo_is_bounded_by_bytes():
    made, memo = [], common.Memo(lambda w: made.append(1) or len(w), most=1 << 20)
    for k in range(100_000):
        assert memo[f"{k:02000}"] == 2000
    assert not memo and len(made) == 100_000
    for k in range(100_000):
        assert memo[f"w{k}"] == len(f"w{k}")
    assert memo.held <= (1 << 20) + 300 and sum(map(len, memo)) < 1 << 20
    assert memo["w99999"] == 6 and len(made) == 200_000


# Pages.

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1><p>Slogan, here.</p></header>
<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div class="cookie-notice">We use cookies, of course.</div>%s
<aside><p>Read also: this, that.</p></aside><form><p>Search, please.</p></form><script>var t="<p>no</p>";</script>
<div id="comments"><article class="comment"><p>Great post, thanks, really great, many words, and more.</p></article></div><footer>&copy; me, 2020.</footer></body></html>"""


def test_article_is_found():
    page = PAGE % "<article><h1>Title &amp; more</h1><p><b>First &lt;para&gt;,\n with&nbsp;space.<br>Next.<p>Second <a href=3>link</a>, too.</p><!-- no --><p>x</p><div class='ad'>Buy, now.</div></article>"
    assert html.main_text(page) == "Title & more\nFirst <para>, with space. Next.\nSecond link, too.\nx"


def test_paths_find_text_without_an_article():
    body = "".join(f"<p>Paragraph {k}, with some words, and a full stop at its end. More follows here.</p>" for k in range(5))
    text = html.main_text(PAGE % f"<div class='page'><h2>Head</h2><div class='body'>{body}</div></div>")
    assert text.split("\n")[0] == "Head" and len(text.split("\n")) == 6 and "cookies" not in text and "Great" not in text


LONG = "<p>Paragraph {}, with some words, and a full stop at its end. More follows here, and more, to the end.</p>"


def test_paths_decide_inside_an_article():
    page = PAGE % f"<article><h1>Head</h1>{''.join(LONG.format(k) for k in range(8))}<p>Short.</p><div class='meta'><div>Posted by me</div><div>Filed</div><div>Views 3</div><div>Id 7</div><div>Tags</div></div></article>"
    lines = html.main_text(page).split("\n")
    assert len(lines) == 10 and lines[0] == "Head" and lines[-1] == "Short."


def test_lists_tables_and_quotes_of_an_article_stay():
    parts = "<ul><li>first</li><li>second <b>item</b></li></ul><table><tr><td>1</td><td>2</td></tr></table><blockquote>Said</blockquote><pre>x = 1</pre><figure><img src=a><figcaption>Shown</figcaption></figure><dl><dt>t<dd>d</dl>"
    page = f"<article><h1>Head</h1>{''.join(LONG.format(k) for k in range(6))}<h2>List</h2>{parts}<div class=box><div>Buy now</div><div>cheap</div></div></article>"
    lines = html.main_text(PAGE % page).split("\n")
    assert lines[0] == "Head" and lines[7:] == ["List", "first", "second item", "1", "2", "Said", "x = 1", "Shown", "t", "d"]
    plain = page.replace("article", "div")
    assert html.main_text(PAGE % plain).split("\n")[7:] == lines[7:]


def test_text_of_all_sections_and_articles():
    parts = [LONG.format(k) * n for k, n in enumerate((6, 1, 2))]
    for page in (f"<div id=content>{''.join(f'<section>{p}</section>' for p in parts)}</div>", "".join(f"<article>{p}</article>" for p in parts)):
        assert len(html.main_text(PAGE % page).split("\n")) == 9


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>just, text.</p>"), (None, "u", "<script>x"), (5, "u", "a < b & c &amp; d"), (6, "u", "<div" * 50)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(pages).collect()}
    assert got[1] == got[2] == got[None] == ("", 0) and got[3] == ("just, text.", 11) and got[5][0] == "a < b & c & d"
    assert html.extract(pages.where("page_id > 9")).count() == 0


@pytest.mark.parametrize("name", ["layout has-sidebar", "post no-comments", "page with-banner", "tags-list post", "theme-print content", "content-alert", "print", "search"])
@pytest.mark.parametrize("element", ["article", "section"])
def test_wrappers_with_furniture_words_keep_their_text(name, element):
    body = "".join(LONG.format(k) for k in range(5))
    comments = f"<div class='user-comments'><article class='comment'><p>{'Great, post. ' * 90}</p></article></div>"
    page = f"<body><div class='{name}'><{element}><h1>Head</h1>{body}</{element}><div class='sidebar'>Side, bar.</div></div>{comments if element == 'article' else ''}<div class='site-footer'>End, here.</div>"
    lines = html.main_text(page).split("\n")
    assert len(lines) == 6 and lines[0] == "Head"


def test_names_of_headings_and_header_of_an_article_are_no_furniture():
    page = f"<article><header><h1 id='feedback'>Head</h1></header>{''.join(LONG.format(k) for k in range(4))}</article>"
    assert html.main_text(PAGE % page).split("\n")[0] == "Head"


def test_pages_without_text_of_note_are_empty():
    for page in ("", " ", "<p></p>", "<nav>a, b</nav>", "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul>", "<script>var a = 'text, text.'</script>", "<!-- never closed <p>x"):
        assert html.main_text(page) == ""


@pytest.mark.parametrize("piece", ["<div>x", '<a "', "<a ='", "<p>x", "<span class='ad'>x", "<ul><li>x", "< ", "<table><tr><td>x", "<b-x>x</c-y>", "<p x ", "<div class='a-ad'>x"])
def test_pages_take_linear_time_and_memory(piece):
    import time
    import tracemalloc

    def cost(size):
        page = piece * (size // len(piece))
        at = time.process_time()
        html.main_text(page)
        return time.process_time() - at

    assert min(cost(800_000) for _ in range(2)) < 24 * max(0.02, min(cost(100_000) for _ in range(2)))  # quadratic: 64 times
    tracemalloc.start()
    html.main_text(piece * (200_000 // len(piece)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000


class Paths(HTMLParser):
    """Blocks of a well-formed page with their whole paths, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.path, self.blocks, self.links, self.fresh = [], [], 0, True

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.links += 1
        else:
            self.path.append(tag)
            self.fresh = True

    def handle_endtag(self, tag):
        if tag == "a":
            self.links -= 1
        else:
            self.path.pop()
            self.fresh = True

    def handle_data(self, data):
        if self.fresh:
            self.blocks.append([tuple(self.path), "", 0])
            self.fresh = False
        self.blocks[-1][1] += data
        if self.links:
            self.blocks[-1][2] += len(data)


def scored_by_definition(page):
    parser = Paths()
    parser.feed(page)
    blocks = parser.blocks
    marks = lambda t: sum(c in ".,;:!?" for c in t)
    ratio = {}
    for path in {b[0] for b in blocks}:
        mine = [b for b in blocks if b[0] == path]
        ratio[path] = (sum(len(t) - k for _, t, k in mine) / len(mine), sum(marks(t) for _, t, k in mine if k < len(t)) / len(mine))
    at = lambda k: ratio[blocks[min(max(k, 0), len(blocks) - 1)][0]]
    smooth = [[(at(k - 1)[j] + 2 * at(k)[j] + at(k + 1)[j]) / 4 for j in (0, 1)] for k in range(len(blocks))]
    scores = [t * (1 + m) for t, m in smooth]
    mean = sum(scores) / len(scores)
    content = {p for p in ratio if (own := [s for b, s in zip(blocks, scores) if b[0] == p]) and sum(own) / len(own) >= 0.5 * mean}

    def home(path):
        while path and path[-1] in ("p", "blockquote", "ul", "li"):
            path = path[:-1]
        return path

    homes = {home(p) for p, t, k in blocks if p in content and k < len(t)}
    return "\n".join(t for p, t, k in blocks if (p in content or home(p) in homes) and k < len(t) and (k < 0.9 * len(t) or p[-1] == "p"))


def test_path_scores_equal_brute_force():
    rng = random.Random(31)

    def element(depth):
        tag = rng.choice(["div", "section", "p", "blockquote", "ul"] if depth < 4 else ["p"])
        if tag == "p" or depth == 4:
            words = " ".join(rng.choice(["word", "and", "end.", "so,", "text"]) for _ in range(rng.choice([2, 4, 30, 60])))
            return f"<p><a>{words}</a></p>" if rng.random() < 0.25 else f"<p>{words}</p>"
        inner = [element(depth + 1) for _ in range(rng.randrange(1, 5))]
        return f"<{tag}>{''.join(f'<li>{x}</li>' if tag == 'ul' else x for x in inner)}</{tag}>"

    for _ in range(80):
        page = f"<html><body>{''.join(element(0) for _ in range(rng.randrange(1, 6)))}</body></html>"
        assert html.main_text(page) == scored_by_definition(page)


def test_long_pages_and_clashing_columns(spark):
    long = f"<article>{''.join(LONG.format(k) for k in range(20_000))}</article>"
    pages = spark.createDataFrame([(1, "u", long, 5, "x"), (1, "u", long, 5, "x"), (None, None, None, None, None)], "page_id long, url string, html string, n_chars long, text string")
    rows = html.extract(pages).collect()
    assert len(rows) == 3 and rows[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert sorted(r["text"].count("\n") for r in rows) == [0, 19_999, 19_999]


# Quality.


def corpus(n, seed=4):
    """Prose, of which some is junk (quality 0), some abusive (toxic 1)."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [f"{rng.choice('abcdefgh')}{rng.choice(['ing', 'ed', 'er', 'on'])}{rng.randrange(60)}" for _ in range(rng.randrange(30, 90))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        if bad:
            words = [w.upper() + "!!" if rng.random() < 0.8 else w + "%%%" for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Idiot", "scum", "moron."]) if rng.random() < 0.7 else f"vexing{rng.randrange(40)}")
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_resampling_prefers_good_text(spark, frame):
    rows, labels = corpus(400)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(rows + [(900, None), (901, "")], keep=1, gumbel=2)
    kept = {r["doc_id"] for r in quality.resample(docs, table).collect()}
    good = {i for i, q, _ in labels if q}
    assert len(kept & good) >= 0.95 * len(good) and len(kept - good - {900, 901}) <= 4
    assert kept == {r["doc_id"] for r in quality.resample(docs.repartition(7), table).collect()}
    assert quality.resample(docs.where("doc_id < 0"), table).count() == 0
    assert quality.resample(docs, table.where("quality > 5")).count() == 402


def test_kth_largest_is_exact(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 300) for _ in range(500)] + [1.5] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    exact = lambda x: round(x * (1 << quality.PLACES)) + (1 << (quality.WIDTH - 1))
    for k in (1, 7, 250, 300, 520):
        assert abs(quality.kth_largest(df, "x", k) - exact(ordered[k - 1])) <= 1
    assert quality.kth_largest(df, "x", 521) is None
    assert quality.kth_largest(spark.createDataFrame([(-3e11,), (2e11,)], "x double"), "x", 2) == exact(-3e11)


def features_by_definition(text):
    """Buckets of tokens, capitals and pairs, one at a time."""
    ids = []
    for word in text.split():
        for token in re.findall(r"[^\W_]+|[^\w\s]+|_+", word):
            ids.append(zlib.crc32(token.lower().encode()))
            ids += [1] if len(token) > 1 and token.isupper() else []
    pairs = []
    for a, b in zip(ids, ids[1:]):
        x = (a * 0x9E3779B1 + b * 0x85EBCA77) % 2**64
        pairs.append(2 if a == b else x ^ (x >> 17))
    return [x % quality.BUCKETS for x in ids + pairs]


def test_resampling_equals_brute_force(spark, frame):
    rows, labels = corpus(150, seed=12)
    rows += [(7, "another text of id seven"), (None, "no id"), (None, "no id, other text"), (None, "no id"), (900, None), (901, ""), (902, "Long TEXT, long text. " * 3000)]
    docs, table = frame(rows, gumbel=1, log_weight=2), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good_ids = {i for i, q, _ in labels if q}
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(found := features_by_definition(t or ""))
        if i in good_ids:
            good.update(found)
    size = quality.BUCKETS * quality.SMOOTH
    ratio = {b: math.log((good[b] + 1) / (sum(good.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size)) for b in raw}
    draws = docs.select("doc_id", "text", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(1)).alias("draw")).collect()
    want = []
    for r in draws:
        weight = sum(ratio[b] for b in features_by_definition(r["text"] or ""))
        noise = (((r["draw"] % 2**64) >> 12) + 0.5) / 2**52
        want.append((weight - math.log(-math.log(noise)), r["doc_id"], weight))
    want.sort(key=lambda x: -x[0])
    k = math.ceil(len(rows) * len(good_ids) / len(labels))
    want = [w for w in want if w[0] >= want[k - 1][0] - 1e-9]
    got = sorted(((r["gumbel"], r["doc_id"], r["log_weight"]) for r in quality.resample(docs, table).collect()), key=lambda x: -x[0])
    assert [g[1] for g in got] == [w[1] for w in want]
    assert all(math.isclose(g[j], w[j], rel_tol=1e-9, abs_tol=1e-6) for g, w in zip(got, want) for j in (0, 2))


# Toxicity.


def best_segments(scores):
    """Maximal scoring segments by the textbook: the best segment first, then left and right of it."""
    best = max(((sum(scores[i : j + 1]), -(j - i), i, j) for i in range(len(scores)) for j in range(i, len(scores))), default=(0,))
    if best[0] <= 1e-12:
        return []
    _, _, i, j = best
    return [*best_segments(scores[:i]), (round(best[0], 6), i, j), *((s, a + j + 1, b + j + 1) for s, a, b in best_segments(scores[j + 1 :]))]


def test_segments_equal_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        hits = [(i, rng.choice([0.5, 1.1, 3.3])) for i in range(rng.randrange(30)) if rng.random() < 0.3]
        size = hits[-1][0] + 1 if hits else 0
        scores = [dict(hits).get(i, -0.25) for i in range(size)]
        assert [(round(s, 6), a, b) for s, a, b in toxicity.segments(hits)] == best_segments(scores)


def test_toxicity_on_held_out_rows(spark, frame):
    rows, labels = corpus(900, seed=7)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(rows + [(2000, None), (2001, "")], score=1)
    model = toxicity.train(docs, table)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model, to="score2").collect()}
    held = {r[0] for r in spark.createDataFrame(labels, "doc_id long, q int, t int").where(toxicity.held_out(F.col("doc_id"))).collect()}
    right = [(got[i]["score2"] >= toxicity.THRESHOLD) == bool(t) for i, _, t in labels if i in held]
    assert len(right) > 200 and sum(right) / len(right) > 0.95
    assert got[2000]["score2"] == got[2001]["score2"] < 0.3 and got[0]["score"] == 1
    assert 0 < toxicity.passages(docs, model).count() < 900
    assert toxicity.scores(docs.where("doc_id < 0"), model, to="x").count() == 0
    blank = toxicity.train(docs, table.where("toxic > 5"))
    assert len({r["x"] for r in toxicity.scores(docs, blank, to="x").collect()}) == 1


def test_held_out_rule(spark):
    rows = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_clean_words_with_a_toxic_prefix_do_not_inherit_it(spark, frame):
    """A word of many clean documents scores nothing although its prefix is that of toxic words."""
    rows, labels = corpus(900, seed=7)
    rows = [(i, t + " vexillology" if not toxic and i % 9 == 0 else t) for (i, t), (_, _, toxic) in zip(rows, labels)]
    model = toxicity.train(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any("vexillology".startswith(p) for p in model.prefixes)
    assert model.score("vexillology") == 0.0 and model.score("vexing999") > 0 and model.score("vexinggg") > 0


def test_scores_on_odd_and_long_rows(spark, frame):
    rows, labels = corpus(300, seed=9)
    table = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    toxic = next(t for (_, t), (_, _, y) in zip(rows, labels) if y)
    docs = frame([*rows, *ODD, (3, "a second text of id three"), (800, "calm words " * 100_000), (801, "calm words " * 50_000 + toxic + " calm words" * 50_000)], score=1)
    model = toxicity.train(docs, table)
    out = toxicity.scores(docs, model)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r["doc_id"]: r["score"] for r in out.where("doc_id >= 800").collect()}
    assert got[800] < 0.3 and got[801] > got[800]
    scorer = toxicity.Scorer(model)
    bare = [model.score(w) for w in toxicity.words_of(toxic)]
    found = [(round(s, 6), a, b) for s, a, b in scorer(toxic)[0]]
    assert found == best_segments([x if x else -toxicity.DRIFT for x in bare])


# The pipeline.


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= seen
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen = docs.count()
    assert corpus_pipeline.run(spark, folder).count() == seen


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, stage):
    import corpus_pipeline

    rows = [(i, t, "en", None, len(t or "")) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    function = corpus_pipeline.STAGES[stage][1]
    assert 0 < function(spark, docs, "/root/testdata/sf0.001").count() <= len(rows)
    assert function(spark, docs.where("doc_id > 99"), "/root/testdata/sf0.001").count() == 0
