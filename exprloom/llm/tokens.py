"""Token counts exactly as a public tokenizer's library gives them.

Texts of ordinary length are counted word by word: the tokenizer drops white space and no token spans
it, so a text has as many tokens as its words have, and each distinct word is encoded once per task.
Huge texts are encoded in overlapping chunks with offsets.  Two neighbours are spliced at a common
boundary that is proven stable: a place inside the overlap where both encodings begin a token and the
tokenizer's own splitting always cuts, whatever stands around.  If an overlap holds none, it is
widened, and at last the chunk is doubled, so that even a text of one single word is encoded a bounded
number of times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, bytes_of

#: Characters of a chunk and of an overlap; texts up to one chunk are not cut.
CHUNK, OVERLAP = 1 << 16, 1 << 8

_PLAIN = re.compile(rb"[\x21-\x7e]+")
#: Where splitting always cuts: behind white space, on both sides of a digit, and between letters and marks, of which the
#: apostrophe is left out, since it may begin a piece with letters.
_CUT = re.compile(r"(?<=[ \t\n\r\x0b\x0c])(?=\S)|(?<=[0-9])|(?=[0-9])|(?<=[A-Za-z])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z])")


class Counter:
    """Counts tokens with the library's tokenizer at ``path``; text is never truncated, padded or given added tokens."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model, self.chunk, self.overlap = self.lib.model, chunk, overlap
        self.memo: Memo = Memo(self.word)
        self.pieces: Memo = Memo(lambda piece: len(self.model.tokenize(piece)), most=32 << 20)
        #: Within printable ASCII the tokenizer's own splitting pattern reduces to this one.
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall

    def word(self, word: bytes) -> int:
        """Tokens of one word.  Printable ASCII goes straight to the library's model, anything else, and what may
        hold a special token, through the whole library."""
        if not _PLAIN.fullmatch(word) or b"<|" in word:
            return len(self.lib.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return sum([self.pieces[piece] for piece in self.split(word.decode().lower())])

    def count(self, data: bytes) -> int:
        if len(data) > self.chunk:
            text = data.decode("utf-8", "replace")
            if len(text) > self.chunk:
                return self.count_huge(text)
        memo = self.memo
        return sum([memo[w] for w in data.split()])

    def starts(self, text: str, first: int, last: int) -> list[int]:
        """Where tokens of ``text[first:last]`` begin, as positions in ``text``."""
        return [first + a for a, _ in self.lib.encode(text[first:last], add_special_tokens=False).offsets]

    def splice(self, text: str, mine: list[int], theirs: list[int], low: int, high: int) -> int | None:
        """The last stable boundary between ``low`` and ``high`` (both exclusive) where both encodings begin a token."""
        shared = set(mine).intersection(theirs)
        return max((p for p in shared if low < p < high and _CUT.match(text, p)), default=None)

    def count_huge(self, text: str) -> int:
        """Overlap resynchronisation: the tokens of each chunk between the splices at its two ends."""
        total, low, first, size = 0, 0, 0, len(text)
        last = min(size, self.chunk)
        mine = self.starts(text, first, last)
        while last < size:
            begin, overlap, at = first, self.overlap, None
            while at is None:
                begin = max(first, last - overlap)
                end = min(size, last + self.chunk)
                theirs = self.starts(text, begin, end)
                at = self.splice(text, mine, theirs, max(begin, low), last)
                if at is None and begin == first:
                    break
                overlap *= 4
            if at is None:  # no boundary in the whole chunk: make it longer instead
                last = min(size, 2 * last - first)
                mine = self.starts(text, first, last)
                continue
            total += sum(low <= p < at for p in mine)
            low, first, last, mine = at, begin, end, theirs
        return total + sum(p >= low for p in mine)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row of ``docs`` (doc_id, text; more columns are ignored).

    ``path`` is a tokenizer file that executors can read.  Null counts as the empty text: no bytes, no tokens.
    Repeated rows and null ids give a row each; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, chunk, overlap)
        for batch in batches:
            rows = [(len(data), counter.count(data)) for data in bytes_of(batch)]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[1] > limit for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
