"""Splitting oversized texts at natural boundaries, by recursive bisection in token space.

A text of more than ``max_tokens`` tokens is cut at the strongest boundary near its middle; halves still longer than
``max_tokens - overlap_tokens`` are cut again; at last every piece but the first is extended to the left by
``overlap_tokens`` tokens of the piece before. Boundaries, strongest first: blank line, line end, sentence end, clause
mark, edge of a word. Text without any of them is cut between tokens, never inside a character.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from citegrove.llm.tokens import Encoder, without_gc

#: Line ends with the blanks after them, sentence ends within a line, and sentence marks that need no blank. A mark
#: before a small letter or a digit ends no sentence (abbreviations, numbers). A cut comes after the blanks.
_LINES = re.compile(r"[\n\r]\s*")
_SENTENCES = re.compile(r"""[.!?…]["'”’»)\]]*[^\S\n\r]+(?![\n\r0-9a-zß-öø-ÿ])""")
_WIDE_SENTENCES = re.compile(r"[。！？]+")
_CLAUSES = re.compile(r"[,;:]\s+|[，；、：]")


def _nearest(positions: list[int], middle: int, first: int, last: int) -> int:
    """Of ascending positions the one nearest to the middle, if it lies within first..last, else -1; of equal ones the lower."""
    k = bisect_left(positions, middle)
    above = positions[k] if k < len(positions) else 1 << 60
    below = positions[k - 1] if k else -1
    if below >= first and middle - below <= above - middle:
        return below
    return above if above <= last else below if below >= first else -1


class Text:
    """A text's words (the split before the merges), the tokens and characters before each, and its boundaries."""

    def __init__(self, text: str, encoder: Encoder) -> None:
        self.text, self.encoder, self.words = text, encoder, encoder.split(text)
        self.ids = list(map(encoder.words.__getitem__, self.words))
        self.token_at = list(accumulate(map(len, self.ids), initial=0))
        self.char_at = list(accumulate(map(len, self.words), initial=0))
        self.size = self.token_at[-1]
        self._strong: tuple[list[int], list[int], list[int]] | None = None
        self._clauses: list[int] | None = None

    def _edge(self, m: re.Match[str]) -> int:
        """The token position of the last word edge within a match, after its first letter; -1 if it has none.

        A single blank before a word is part of that word.
        """
        k = bisect_right(self.char_at, m.end()) - 1
        return self.token_at[k] if self.char_at[k] > m.start() else -1

    @property
    def strong(self) -> tuple[list[int], list[int], list[int]]:
        """Ascending token positions after blank lines, line ends and sentence ends; looked for when the first cut is made."""
        if self._strong is None:
            text, edges, at = self.text, self.char_at, self.token_at
            lines: list[int] = []
            blank_lines: list[int] = []
            for m in _LINES.finditer(text):
                if (edge := self._edge(m)) >= 0:
                    mark = m[0]
                    (blank_lines if (mark.count("\n") or mark.count("\r")) > 1 else lines).append(edge)
            # blanks follow the mark, so a word ends between
            sentences = [at[bisect_right(edges, m.end()) - 1] for m in _SENTENCES.finditer(text)]
            if "。" in text or "！" in text or "？" in text:
                sentences = sorted({*sentences, *(e for m in _WIDE_SENTENCES.finditer(text) if (e := self._edge(m)) >= 0)})
            self._strong = blank_lines, lines, sentences
        return self._strong

    @property
    def clauses(self) -> list[int]:
        if self._clauses is None:
            self._clauses = [e for m in _CLAUSES.finditer(self.text) if (e := self._edge(m)) >= 0]
        return self._clauses

    def _inside(self, at: int) -> bool:
        """Whether a token position lies inside a character."""
        k = bisect_right(self.token_at, at) - 1
        if self.token_at[k] == at or at >= self.size:
            return False
        return self.encoder.machine.bytes_of[self.ids[k][at - self.token_at[k]]][0] & 0xC0 == 0x80

    def whole_char(self, at: int) -> int:
        """The nearest token position at or before ``at`` that does not lie inside a character."""
        while self._inside(at):
            at -= 1
        return at

    def chars_before(self, at: int) -> int:
        """Characters before a token position that lies between characters."""
        k = bisect_right(self.token_at, at) - 1
        if self.token_at[k] == at:
            return self.char_at[k]
        inside = b"".join(map(self.encoder.machine.bytes_of.__getitem__, self.ids[k][: at - self.token_at[k]]))
        return self.char_at[k] + len(inside.decode("utf-8"))

    def tokens_alone(self, start: int, end: int, at: int) -> int:
        """Tokens of the text between two positions, ``at`` being the character of the first, when encoded by itself.

        They are the same tokens, except where blanks at the end join, or where the rest of a word begun in its middle
        starts with a mark or blank and may join what follows.
        """
        n = end - start
        k = bisect_right(self.token_at, start) - 1
        if self.token_at[k] != start and not self.text[at].isalnum():
            stop = min(k + 2, len(self.words))
            while stop < len(self.words) and self.words[stop - 1].isspace():
                stop += 1
            upto = min(self.token_at[stop], end)
            n += self.encoder.count(self.text[at : self.chars_before(upto)]) - (upto - start)
            if upto == end:
                return n
        last = bisect_left(self.token_at, end) - 1
        if self.words[last].isspace() and last > k + 1 and self.words[last - 1].isspace():
            first = last - 1
            while first > k + 1 and self.words[first - 1].isspace():
                first -= 1
            from_ = max(start, self.token_at[first])
            blanks = self.text[self.chars_before(from_) : self.chars_before(end)]
            n += len(self.encoder.words[blanks]) - (end - from_)
        return n

    def cut(self, low: int, high: int) -> int:
        """Where to cut tokens low..high: the strongest boundary, of equal ones the nearest to the middle.

        First within the middle half; a text without any there is searched up to its ends. Words' edges come after all
        boundaries, places between tokens last.
        """
        middle = (low + high) // 2
        for share in (4, 50):
            margin = max(1, (high - low) // share)
            first, last = low + margin, high - margin
            for positions in self.strong:
                if positions and (found := _nearest(positions, middle, first, last)) >= 0:
                    return found
            for positions in (self.clauses, self.token_at):
                if (found := _nearest(positions, middle, first, last)) >= 0:
                    return found
        at = self.whole_char(middle)
        if at > low:
            return at
        at = middle + 1
        while at < high and self._inside(at):
            at += 1
        return at

    def cuts(self, most: int) -> list[int]:
        """Token positions 0 = first cut < ... < last = number of tokens, no two more than ``most`` apart."""
        done, todo = [0], [(0, self.size)]
        while todo:
            low, high = todo.pop()
            if high - low > most and (at := self.cut(low, high)) < high:
                todo += [(at, high), (low, at)]
            else:
                done.append(high)
        return done


#: Tokens kept free in each piece, so that an overlap moved left to a whole character still fits.
SPARE = 3


def text_pieces(t: Text, max_tokens: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """(start_token, n_tokens, overlap_tokens, start_char, piece) in order; nothing where the text is within the limit.

    ``overlap_tokens`` is ``overlap`` (or all of the piece before, if that is shorter), and up to SPARE more where the
    overlap would begin inside a character. Where max_tokens leaves no room for that overlap, it is as long as there is room.
    """
    overlap = max(0, min(overlap, max_tokens - SPARE - 1))
    most = max_tokens - overlap - (SPARE if overlap else 0)
    if t.size <= max_tokens:
        return []
    cuts, out, text = t.cuts(most), [], t.text
    end_char = 0
    for k in range(len(cuts) - 1):
        own, end = cuts[k], cuts[k + 1]
        start, at = own, end_char
        if k and overlap:
            start = t.whole_char(max(cuts[k - 1], own - overlap))
            at = t.chars_before(start)
        end_char = t.chars_before(end)
        out.append((start, t.tokens_alone(start, end, at), own - start, at, text[at:end_char]))
    return out


def split_documents(documents: DataFrame, limits: list[tuple[str, int, int]], path: str | None = None) -> DataFrame:
    """Pieces of every document over the limit of a profile; ``limits`` has (profile, max_tokens, overlap_tokens).

    Null and empty texts and texts within the limit give no rows. One narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        least = min((m for _, m, _ in limits), default=0)
        names = ["doc_id", "profile", "piece_no", "start_token", "n_tokens", "overlap_tokens", "start_char", "piece"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        chars = 0
        for batch in without_gc(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or len(text.encode("utf-8", "surrogatepass")) <= least:
                    continue
                whole = Text(text, encoder)
                for profile, most, overlap in limits:
                    for k, piece in enumerate(text_pieces(whole, most, overlap), 1):
                        rows.append((doc_id, profile, k, *piece))
                        chars += len(piece[-1])
                if chars > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, profile string, piece_no int, start_token long, n_tokens int, overlap_tokens int, start_char long, piece string"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def limits_of(piece_limits: DataFrame) -> list[tuple[str, int, int]]:
    """The profiles of the table of limits, a setting that is read whole. Without an overlap it is 0; rows without a name or a limit of a token or more are left out."""
    rows = piece_limits.select("profile", "max_tokens", "overlap_tokens").dropna(subset=["profile", "max_tokens"]).filter("max_tokens > 0").distinct().orderBy("profile", "max_tokens", "overlap_tokens").collect()
    return [(r.profile, r.max_tokens, max(0, r.overlap_tokens or 0)) for r in rows]
