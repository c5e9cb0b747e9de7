"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf path of block tags.  For every
path the text length and the punctuation of all its blocks are added up and divided by the number of
blocks, less what is link text.  Both ratios are smoothed along the page and fused by
multiplication; paths above a threshold are content.  The text is every block on a content path, short
ones too, with the lists, tables, quotes and short paragraphs that stand in the same containers and the
headings right before them; where articles hold such blocks, only what lies in articles.

What stands in navigation, forms, scripts and hidden elements is left out before.  Class, id and role are
hints: an element whose name is that of page furniture is left out; a name that merely contains such
a word, as wrappers often have ("layout has-sidebar"), or that may mean something else ("print"), counts only if
the element does not hold most of the page's text.  Time and memory are linear in the page: paths are interned as parent and tag, and the
scanner never looks at a character twice for want of an end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, texts_of

# Names of HTML elements, and words that mark page furniture in class, id and role.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "br", "wbr"}
BANNED = {"nav", "footer", "aside", "form", "button", "select", "option", "input", "svg", "math", "canvas", "dialog", "menu", "template", "object", "embed", "applet", "audio", "video", "head"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of running text, which belong to the container they stand in.
PROSE = {"p", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption"} | HEADINGS
WORDS = r"ads?|adv|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|newsletter|subscri\w*|signup|login|sidebar|comments?|commentlist|disqus\w*|reply|replies|respond|breadcrumbs?|menus?|nav|navbar|navigation|footer|masthead|toolbar|pagination|pager|complementary|contentinfo|copyright|disclaimer"
WEAK_WORDS = r"notices?|alerts?|modal|overlay|social|share|sharing|related|recommend\w*|widgets?|skip|search|tags|feedback|rating|print"
TOP_WORDS = "header|topbar"
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：«»\"“”„]")

_EXACT, _PART = re.compile(rf"(?:{WORDS})", re.I), re.compile(rf"(?:^|[_-])(?:{WORDS}|{WEAK_WORDS})(?:$|[_-])", re.I)
_TOP_EXACT, _TOP_PART = re.compile(rf"(?:{TOP_WORDS})", re.I), re.compile(rf"(?:^|[_-])(?:{TOP_WORDS})(?:$|[_-])", re.I)
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r">|=\s*([\"'])")
_SPACE = re.compile(r"\s+")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s=/>]+|=")
_BARE, _GAP_ONLY = re.compile(r"\S*"), re.compile(r"\s*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}

OPEN, MAYBE, OUT = range(3)


@dataclass
class Block:
    """A run of text between block boundaries: the number and the last tag of its path, the path of its container, its text,
    how much of it is link text, the article or main element it lies in (0: none), and the nearest element around it that
    may be furniture (-1: none)."""

    path: int
    home: int
    tag: str
    text: str
    linked: int
    region: int
    doubt: int


@dataclass
class Element:
    """An open element: its tag, path, nearest container's path, region, whether it is left out, and the nearest doubtful
    element from it upwards."""

    tag: str
    path: int
    home: int
    region: int
    out: bool
    doubt: int


def _tag_end(page: str, at: int, lost: set[str]) -> int:
    """Where the tag whose name ends at ``at`` ends, behind its ``>``; -1 if it never does.  A ``>`` inside a quoted value does
    not count; a quote that is never closed does not quote.  ``lost`` remembers the quotes that do not occur any more."""
    while stop := _STOP.search(page, at):
        if stop[1] is None:
            return stop.end()
        end = -1 if stop[1] in lost else page.find(stop[1], stop.end())
        if end < 0:
            lost.add(stop[1])
        at = stop.end() if end < 0 else end + 1
    return -1


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name, from what stands between a tag's name and its end."""
    found: dict[str, str] = {}
    at, size = 0, len(text)
    while (at := _GAP.match(text, at).end()) < size:
        key = _KEY.match(text, at)
        if key is None:
            at += 1
            continue
        name, at = key[0].lower(), key.end()
        value, equals = "", _GAP_ONLY.match(text, at).end()
        if text[equals : equals + 1] == "=":
            at = _GAP_ONLY.match(text, equals + 1).end()
            end = text.find(text[at], at + 1) if text[at : at + 1] in ("'", '"') else -1
            if end >= 0:
                value, at = text[at + 1 : end], end + 1
            else:
                bare = _BARE.match(text, at)
                value, at = bare[0], bare.end()
        found.setdefault(name, html.unescape(value))
    return found


def _judge(tag: str, attributes_text: str, inside: bool) -> int:
    """Whether an element is page furniture by its kind or its own name (OUT), may be by a part of its name (MAYBE), or is
    not.  A header inside an article is the article's own, and headings are never furniture by name."""
    if tag in BANNED or (tag == "header" and not inside):
        return OUT
    if not attributes_text or attributes_text.isspace():
        return OPEN
    found = attributes(attributes_text)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return OUT
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return OPEN
    out = OPEN
    for name in " ".join(found.get(k, "") for k in ("class", "id", "role")).split():
        if _EXACT.fullmatch(name) or (not inside and _TOP_EXACT.fullmatch(name)):
            return OUT
        if _PART.search(name) or (not inside and _TOP_PART.search(name)):
            out = MAYBE
    return out


class Reader:
    """One pass over a page; unclosed and misnested tags are tolerated as browsers do."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.doubts: list[int] = []  # for each doubtful element the nearest doubtful one around it
        self.paths: dict[tuple[int, str], int] = {}
        self.stack: list[Element] = [Element("", 0, 0, 0, False, -1)]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.links = self.linked = self.regions = 0
        self.muted: tuple[str, int] | None = None  # an inline element that is left out, and how often it is open

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            top = self.stack[-1]
            if text and not top.out:
                self.blocks.append(Block(top.path, top.home, top.tag, text, min(self.linked, len(text)), top.region, top.doubt))
            self.parts.clear()
        self.linked, self.muted = 0, None

    def add(self, text: str) -> None:
        if text and self.muted is None:
            text = html.unescape(text)
            self.parts.append(text)
            if self.links:
                self.linked += len(text.strip())

    def push(self, tag: str, verdict: int) -> None:
        up = self.stack[-1]
        path = self.paths.setdefault((up.path, tag), len(self.paths) + 1)
        region, doubt = up.region, up.doubt
        if tag in ("article", "main") and not region:
            self.regions += 1
            region = self.regions
        if verdict == MAYBE and not up.out:
            self.doubts.append(doubt)
            doubt = len(self.doubts) - 1
        self.open[tag] += 1
        self.stack.append(Element(tag, path, up.home if tag in PROSE else path, region, up.out or verdict == OUT, doubt))

    def close(self, tags: set[str], within: set[str] | frozenset[str] = frozenset()) -> bool:
        """Close the nearest open element among ``tags``, with all inside it, unless one of ``within`` is nearer."""
        if not any(self.open[t] for t in tags):
            return False
        at = len(self.stack) - 1
        while at and self.stack[at].tag not in tags:
            if self.stack[at].tag in within:
                return False
            at -= 1
        self.flush()
        for e in self.stack[at:]:
            self.open[e.tag] -= 1
        del self.stack[at:]
        return True

    def inline(self, tag: str, closing: bool, rest: str) -> None:
        if self.muted is not None:
            if tag == self.muted[0]:
                depth = self.muted[1] + (-1 if closing else 1)
                self.muted = (tag, depth) if depth else None
            return
        if tag == "a":
            self.links = max(0, self.links - 1) if closing else self.links + 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag not in VOID and not closing and rest and _judge(tag, rest, True) == OUT:
            self.muted = (tag, 1)

    def block(self, tag: str, closing: bool, rest: str) -> None:
        if closing:
            if self.close({tag}):
                self.links = 0
            else:
                self.flush()
            return
        if tag in CLOSES_P:
            self.close({"p"})
        if tag in SAME:
            while self.close(SAME[tag], SCOPE[tag]):
                pass
        if tag == "body":
            self.close({"head"})
        self.flush()
        if tag not in VOID:
            self.push(tag, _judge(tag, rest, self.stack[-1].region > 0))

    def read(self, page: str) -> None:
        at, size, lost = 0, len(page), set()
        while at < size:
            mark = page.find("<", at)
            if mark < 0:
                self.add(page[at:])
                break
            name = _NAME.match(page, mark + 1)
            if name is None:
                after = page[mark + 1 : mark + 2]
                if after not in ("!", "?", "/") or not after:
                    self.add(page[at : mark + 1])  # a bare sign
                    at = mark + 1
                    continue
                self.add(page[at:mark])
                end = page.find("-->", mark + 2) + 2 if page.startswith("<!--", mark) else page.find(">", mark)
                at = size if end < mark + 2 else end + 1
                continue
            self.add(page[at:mark])
            at = _tag_end(page, name.end(), lost)
            if at < 0:
                break
            closing = name[0][0] == "/"
            tag, rest = name[0].lstrip("/").lower(), page[name.end() : at - 1]
            if tag in RAW:
                if not closing:
                    end = _RAW_END[tag].search(page, at)
                    at = end.end() if end else size
            elif tag in INLINE:
                self.inline(tag, closing, rest)
            else:
                self.block(tag, closing, rest)
        self.flush()


def blocks_of(page: str) -> list[Block]:
    """The page's visible text blocks in order, without what stands in page furniture.

    An element that may be furniture by a part of its name is none if it holds at least half of the text: of the text in
    articles if there is any, else of all that is left."""
    reader = Reader()
    reader.read(page)
    blocks, doubts = reader.blocks, reader.doubts
    if not doubts:
        return blocks
    inside = any(b.region for b in blocks)
    own = [len(b.text) - b.linked if b.region or not inside else 0 for b in blocks]
    held = [0] * len(doubts)
    for b, n in zip(blocks, own, strict=True):
        if b.doubt >= 0:
            held[b.doubt] += n
    for k in range(len(doubts) - 1, -1, -1):  # an inner element has the greater number
        if doubts[k] >= 0:
            held[doubts[k]] += held[k]
    total, out = sum(own), []
    for k, up in enumerate(doubts):
        out.append((up >= 0 and out[up]) or 2 * held[k] < total or not held[k])
    return [b for b in blocks if b.doubt < 0 or not out[b.doubt]]


def _smooth(values: list[float]) -> list[float]:
    """Weights 1, 2, 1 along the page."""
    n = len(values)
    return [(values[max(0, k - 1)] + 2 * values[k] + values[min(n - 1, k + 1)]) / 4 for k in range(n)]


def content_scores(blocks: list[Block]) -> list[float]:
    """For each block the fused ratio of its path: own text a block, times punctuation a block, both smoothed."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        total = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        total[0] += len(b.text) - b.linked
        total[1] += len(PUNCTUATION.findall(b.text)) if b.linked < len(b.text) else 0
        total[2] += 1
    text = _smooth([sums[b.path][0] / sums[b.path][2] for b in blocks])
    marks = _smooth([sums[b.path][1] / sums[b.path][2] for b in blocks])
    return [t * (1 + m) for t, m in zip(text, marks, strict=True)]


def main_text(page: str, threshold: float = 0.5) -> str:
    """The article's blocks, one a line.  ``threshold`` is the share of the mean fused score that marks content."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    scores = content_scores(blocks)
    mean = sum(scores) / len(scores)
    paths: dict[int, list[float]] = {}
    for b, s in zip(blocks, scores, strict=True):
        paths.setdefault(b.path, []).append(s)
    content = {p for p, each in paths.items() if sum(each) >= threshold * mean * len(each)}
    homes = {b.home for b in blocks if b.path in content and b.linked < len(b.text)}
    fits = [b.path in content or (b.home in homes and b.tag not in HEADINGS) for b in blocks]
    good = [f and b.linked < len(b.text) and not _only_links(b) for b, f in zip(blocks, fits, strict=True)]
    # Article and main elements say where the text is, if they hold any; all that do stay together.
    if any(g and b.region for b, g in zip(blocks, good, strict=True)):
        good = [g and b.region > 0 for b, g in zip(blocks, good, strict=True)]
    follows, region = False, 0
    for k in range(len(blocks) - 1, -1, -1):
        if blocks[k].tag in HEADINGS:
            good[k] = good[k] or (follows and blocks[k].region == region)
        else:
            follows, region = good[k], blocks[k].region
    return "\n".join(b.text for b, g in zip(blocks, good, strict=True) if g)


def _only_links(block: Block) -> bool:
    return block.linked >= len(block.text) * 0.9 and block.tag not in HEADINGS and block.tag != "p"


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for each row of ``pages`` (page_id, url, html; more columns are ignored).

    Null and empty pages, and pages without an article, give the empty text.  Repeated rows and null ids give a row
    each; an empty table gives an empty result.  A page is read in one pass, whole, however long.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page) for page in texts_of(batch, "html")]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(by_batch(run), "page_id long, url string, text string, n_chars long")
