"""Encoding with a public byte-level BPE vocabulary, as a lazily determinised finite-state transducer.

The merges are never applied pair by pair to a text. A sequence of tokens is the BPE encoding of its text exactly if
every two neighbours are the encoding of their joint text, so the last token of the encoding of each prefix follows
from the last tokens of shorter prefixes. A state of the transducer holds, for every place from which a token could
still reach past the bytes read so far, the bytes since then and the tokens since the last place all of them share.
Tokens up to that shared place can never change and are emitted; so the lookahead is bounded by the longest token.
States and transitions are made when first met and kept, up to a bound, then dropped and made anew.

Null and empty texts have the empty id list. Ids are those of the vocabulary without special tokens.
"""

from __future__ import annotations

import base64
import codecs
import gc
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The split before the merges (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"


def _plane_pattern() -> re.Pattern[str]:
    """The same split for texts of the basic plane, with its letters, digits and blanks as plain character classes.

    The standard matcher looks such classes up in a bitmap, which takes half the time.
    """
    plane = "".join(map(chr, range(0x10000)))

    def members(kind: str) -> str:
        return "".join(f"{re.escape(plane[m.start()])}-{re.escape(plane[m.end() - 1])}" for m in regex.finditer(f"(?:{kind})+", plane))

    letter, digit, blank = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


#: Bounds of what a worker keeps: transducer states, encoded words, and the longest word kept.
MAX_STATES, MAX_WORDS, MAX_WORD = 200_000, 400_000, 64


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


BYTES = [bytes((b,)) for b in range(256)]


class Transducer:
    """Bytes in, token ids out. A state is (last emitted token or -1, ((open bytes, tokens before them), ...))."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.open = {b[:k] for b in ranks for k in range(1, len(b))}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.grown: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self.split_at: dict[bytes, tuple[bytes, bytes]] = {}
        self._forget()

    def _forget(self) -> None:
        start = (-1, ((b"", ()),))
        self.ids: dict[tuple, int] = {start: 0}
        self.states = [start]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.wanted: set[int] = set()

    def merged(self, word: bytes, until: int = 1) -> list[int]:
        """The encoding by its definition: the lowest-ranked pair is joined first, down to ``until`` parts."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts at the right (-1) or left (0) edge of a token while it grows, with the rank at which each ends."""
        known = self.grown.get((token, side))
        if known is None:
            word, ends, known = self.bytes_of[token], 1 << 60, []
            while True:
                known.append((word, ends))
                if len(word) == 1:
                    break
                word, ends = self._halves(word)[side], self.ranks[word]
            known.reverse()
            self.grown[token, side] = known
        return known

    def _halves(self, word: bytes) -> tuple[bytes, bytes]:
        if (halves := self.split_at.get(word)) is None:
            left, right = self.merged(word, 2)
            halves = self.split_at[word] = (self.bytes_of[left], self.bytes_of[right])
        return halves

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their joint text (a < 0: whether b is that of its own).

        It is unless, while both grow in order of rank, a part at the right edge of a and one at the left edge of b
        live at the same time and their joint rank comes up before either is used within its own token; of equal
        ranks the left one is joined first.
        """
        if a < 0:
            return True
        known = self.neighbours.get((a, b))
        if known is None:
            if len(self.neighbours) > 4 * MAX_WORDS:
                self.neighbours.clear()
            lefts, rights, ranks, i, j = self._edges(a, -1), self._edges(b, 0), self.ranks, 0, 0
            while True:
                left, ends_left = lefts[i]
                right, ends_right = rights[j]
                rank = ranks.get(left + right)
                if rank is not None and rank < ends_left and rank <= ends_right:
                    known = False
                    break
                if ends_left <= ends_right:
                    i += 1
                    if i == len(lefts):
                        known = True
                        break
                else:
                    j += 1
            self.neighbours[a, b] = known
        return known

    def _step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        last, places = state
        here, kept, letter, ranks, can_grow = None, [], BYTES[byte], self.ranks, self.open
        shared = 1 << 30
        for span, before in places:
            longer = span + letter
            if here is None:
                token = ranks.get(longer)
                if token is not None and self.may_follow(before[-1] if before else last, token):
                    here = (*before, token)
            if longer in can_grow:
                kept.append((longer, before))
                if len(before) < shared:
                    shared = len(before)
        if here is None:
            raise ValueError("the vocabulary has a text without an encoding by neighbours")
        if not kept:
            return (here[-1], ((b"", ()),)), here
        kept.append((b"", here))
        while shared and any(before[:shared] != here[:shared] for _, before in kept):
            shared -= 1
        if not shared:
            return (last, tuple(kept)), ()
        return (here[shared - 1], tuple([(span, before[shared:]) for span, before in kept])), here[:shared]

    def _from(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """(end, token) of the tokens that begin at a place, shortest first."""
        ranks, can_grow, out = self.ranks, self.open, []
        for end in range(at + 1, len(word) + 1):
            span = word[at:end]
            token = ranks.get(span)
            if token is not None:
                out.append((end, token))
            if span not in can_grow:
                break
        return out

    def _walked(self, word: bytes) -> list[int]:
        """The encoding by the rule of the transducer for one word, without making states.

        Of the tokens that may follow the last one the longest is taken; where none leads on, the place is given up and
        the token before is shortened. Tokens up to a place are the encoding of the text up to it and so the only ones
        that reach it; hence a place once given up stays so.
        """
        may_follow, n = self.may_follow, len(word)
        out: list[int] = []
        before: list[tuple[int, list[tuple[int, int]]]] = []
        given_up: set[int] = set()
        at, choices = 0, self._from(word, 0)
        while at < n:
            while choices:
                end, token = choices.pop()
                if end not in given_up and (not out or may_follow(out[-1], token)):
                    out.append(token)
                    before.append((at, choices))
                    at, choices = end, self._from(word, end)
                    break
            else:
                given_up.add(at)
                if not before:
                    raise ValueError("the vocabulary has a text without an encoding by neighbours")
                at, choices = before.pop()
                out.pop()
        return out

    def encode(self, word: bytes) -> list[int]:
        """Through the transducer; a transition is made when it is wanted the second time, so that rare words leave none."""
        if len(self.states) > MAX_STATES or len(self.wanted) > 4 * MAX_WORDS:
            self._forget()
        moves, states, at, out = self.moves, self.states, 0, []
        for byte in word:
            key = at << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in self.wanted and len(word) <= MAX_WORD:
                    self.wanted.add(key)
                    return self._walked(word)
                following, emitted = self._step(states[at], byte)
                to = self.ids.get(following)
                if to is None:
                    to = self.ids[following] = len(states)
                    states.append(following)
                move = moves[key] = (to, emitted)
            at, emitted = move
            if emitted:
                out += emitted
        return [*out, *states[at][1][-1][1]]


class _Words(dict):
    """Encodings of words met before; at the bound it starts anew."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.machine.encode(word.encode("utf-8", "surrogatepass")))
        if len(word) <= MAX_WORD:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.machine = Transducer(read_ranks(path))
        self.words = _Words(self.machine)
        self._split, self._split_plane = regex.compile(PATTERN).findall, _plane_pattern().findall

    @classmethod
    def at(cls, path: str | None) -> Encoder:
        """The encoder of a vocabulary file, made once in each worker."""
        path = path or default_path()
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def split(self, text: str) -> list[str]:
        if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return self._split_plane(text)
        return self._split(text)

    def encode(self, text: str | None) -> array:
        return array("i", chain.from_iterable(map(self.words.__getitem__, self.split(text)))) if text else array("i")

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, self.split(text)))) if text else 0

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ids, as it becomes complete: an incremental UTF-8 machine carries open characters over tokens."""
        utf8, of = codecs.getincrementaldecoder("utf-8")("replace"), self.machine.bytes_of
        for i in ids:
            if done := utf8.decode(of[i]):
                yield done
        if done := utf8.decode(b"", True):
            yield done

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.pieces(ids))


def without_gc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with the search for cycles off until the last is done: what an encoder keeps has none, and is large."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield from batches
    finally:
        if was:
            gc.enable()


def _id_lists(texts: list[str | None], encoder: Encoder) -> pa.Array:
    lists = [encoder.encode(t) for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate([np.frombuffer(x, np.int32) for x in lists if len(x)] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encoded(documents: DataFrame, path: str | None = None, rows: int = 256) -> DataFrame:
    """(doc_id, ids) of every document. One narrow pass; texts go through Python in slices of ``rows`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in without_gc(batches):
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(part.column(1).to_pylist(), encoder)], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` of every document, 0 for null and empty texts."""
    base = documents.select(*keep, "text")
    schema = base.drop("text").schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in without_gc(batches):
            counts = pa.array((encoder.count(t) for t in batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts], [*keep, "n_tokens"])

    return base.mapInArrow(run, schema)


def round_trips(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and whether decoding the ids gives the text again (null and empty texts: 0, true)."""
    texts = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in without_gc(batches):
            n, same = [], []
            for t in batch.column(1).to_pylist():
                ids = encoder.encode(t)
                n.append(len(ids))
                same.append(encoder.decode(ids) == (t or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "same"])

    return texts.mapInArrow(run, "doc_id long, n_tokens long, same boolean")
