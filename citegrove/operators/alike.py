"""Texts that difflib finds similar, compared in arrays by exact bounds of its ratio."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np

#: Letters told apart in bounds; the rarer ones count as one letter, which only loosens a bound.
LETTERS = 64
#: Words of pairs, and of texts, whose common subsequences are found at a time.
PAIR_WORDS, TEXT_WORDS = 200_000, 16_384


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def letters_of(texts: list[str]) -> np.ndarray:
    """The most frequent letters of texts, in order."""
    found, n = np.unique(_codes(texts), return_counts=True)
    return np.sort(found[np.argsort(-n, kind="stable")[: LETTERS - 1]])


def words_for(texts: list[str]) -> int:
    """Words of a signature that has about twice as many bits as a text has letters."""
    return max(1, min(3, round(sum(map(len, texts)) / max(1, len(texts)) / 28)))


class Texts:
    """Texts as letters one after another, with sizes and signatures.

    Each letter with its number among the equal ones of its text turns a bit of the signature, so two signatures differ
    in no more bits than the texts in letters.
    """

    def __init__(self, texts: list[str], letters: np.ndarray, words: int) -> None:
        self.texts = texts
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.full(int(self.size.sum()) + 1, LETTERS, np.uint8)  # the last one is no letter
        self.signature = np.zeros((words, len(texts)), np.uint64)
        bits, step = 64 * words, 4096
        for low in range(0, len(texts), step):
            code, size = _codes(texts[low : low + step]), self.size[low : low + step]
            if not len(code):
                continue
            place = np.searchsorted(letters, code)
            place[letters[np.minimum(place, len(letters) - 1)] != code] = LETTERS - 1
            self.flat[self.start[low] : self.start[low] + len(code)] = place
            row = np.repeat(np.arange(len(size)), size)
            key = row * LETTERS + place
            order, at = np.argsort(key, kind="stable"), np.arange(len(key))
            first = np.maximum.accumulate(np.where(np.r_[True, np.diff(key[order]) != 0], at, 0))
            no = np.empty(len(key), np.int64)
            no[order] = at - first
            bit = ((no * LETTERS + place + 1) * 0x9E3779B1 >> 8) % bits
            odd = (np.bincount(row * bits + bit, minlength=len(size) * bits) & 1).astype(np.uint8)
            self.signature[:, low : low + step] = np.packbits(odd.reshape(-1, 8), axis=1).reshape(len(size), words, 8).view(np.uint64)[:, :, 0].T

    def some(self, which: np.ndarray) -> Texts:
        """Some of the texts, which share the letters."""
        out = object.__new__(Texts)
        out.texts, out.size, out.start, out.flat, out.signature = [self.texts[k] for k in which.tolist()], self.size[which], self.start[which], self.flat, self.signature[:, which]
        return out

    def at(self, which: np.ndarray, i: int) -> np.ndarray:
        """Letter i of each of these texts; LETTERS where the text has ended."""
        return self.flat[np.where(i < self.size[which], self.start[which] + i, -1)]

    def masks(self, which: np.ndarray) -> np.ndarray:
        """Of each of these texts and each letter, where the text has the letter, as bits of words."""
        longest = int(self.size[which].max(initial=1))
        out, every = np.zeros((len(which), LETTERS + 1, -(-longest // 64)), np.uint64), np.arange(len(which))
        for i in range(longest):
            out[every, self.at(which, i), i // 64] |= np.uint64(1 << i % 64)
        out[:, LETTERS] = 0
        return out


def apart(threshold: float, sizes: np.ndarray | int) -> np.ndarray:
    """Letters that two texts may have outside of their common subsequence, by the sum of their sizes."""
    return ((1 - threshold) * np.asarray(sizes) + 1e-9).astype(np.int64)


def common(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray) -> np.ndarray:
    """Letters of the longest common subsequences of texts i of a and j of b, at least."""
    used, place = np.unique(j, return_inverse=True)
    masks = b.masks(used)
    words, flat = masks.shape[2], masks.reshape(-1)
    base = place * ((LETTERS + 1) * words)
    free = [np.full(len(i), ~np.uint64(0)) for _ in range(words)]
    for x in range(int(a.size[i].max(initial=0))):
        at, carry = base + a.at(i, x).astype(np.int64) * words, None
        for k in range(words):
            here = flat[at + k]
            hit = free[k] & here
            total = free[k] + hit
            over = total < hit
            if carry is not None:
                total = total + carry
                over |= total < carry
            free[k] = total | (free[k] & ~here)
            carry = over.astype(np.uint64)
    return 64 * words - sum(np.bitwise_count(f).astype(np.int64) for f in free)


def near(a: Texts, b: Texts, threshold: float, before: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bound) of the pairs of a text of a and one of b whose matcher ratio can reach the threshold; its bound.

    No pair is missed: the ratio is at most that of the common subsequence, and what lies outside of it is at least what
    the signatures differ in. All pairs of a text of b come together. ``before``: for each text of b, how many of the
    first ones of a it meets.
    """
    order = np.argsort(a.size, kind="stable")
    size, signature = a.size[order], a.signature[:, order]
    ahead, found, pairs, texts, last, limit = [], [], 0, 0, -1, None
    sequence = np.argsort(b.size, kind="stable")

    def settled() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if ahead:
            i, j = np.concatenate(ahead), np.repeat(found, [len(x) for x in ahead])
            both = a.size[i] + b.size[j]
            same = np.minimum(common(a, i, b, j), np.minimum(a.size[i], b.size[j]))
            fit = both - 2 * same <= apart(threshold, both)
            if fit.any():
                yield i[fit], j[fit], 2.0 * same[fit] / both[fit]

    for j in sequence.tolist():
        m = int(b.size[j])
        if not m:
            continue
        if m != last:
            low, high = np.searchsorted(size, [threshold * m / (2 - threshold) - 1e-6, m * (2 - threshold) / threshold + 1e-6])
            high = np.searchsorted(size, m * (2 - threshold) / threshold + 1e-6, "right")
            last, limit, words = m, np.minimum(apart(threshold, size[low:high] + m), 255).astype(np.uint8), -(-m // 64)
        differ = np.bitwise_count(signature[0, low:high] ^ b.signature[0, j])
        for k in range(1, len(signature)):
            differ += np.bitwise_count(signature[k, low:high] ^ b.signature[k, j])
        i = order[low:high][differ <= limit]
        if before is not None:
            i = i[i < before[j]]
        if len(i):
            if pairs and ((pairs + len(i)) * words > PAIR_WORDS or (texts + 1) * words > TEXT_WORDS):
                yield from settled()
                ahead, found, pairs, texts = [], [], 0, 0
            ahead.append(i)
            found.append(j)
            pairs, texts = pairs + len(i), texts + 1
    yield from settled()


def best(a: Texts, b: Texts, threshold: float, before: np.ndarray | None = None) -> dict[int, int]:
    """For texts of b their most similar one of a, of equally similar ones the greatest text, if it reaches the threshold."""
    out, match = {}, difflib.SequenceMatcher(None, autojunk=False)
    for i, j, bound in near(a, b, threshold, before):
        used = np.unique(i).tolist()
        rank = dict(zip(sorted(used, key=a.texts.__getitem__), range(len(used)), strict=True))
        order = np.lexsort((-np.array([rank[x] for x in i.tolist()]), -bound, j))
        done, top, who = -1, 0.0, ""
        for x, y, most in zip(i[order].tolist(), j[order].tolist(), bound[order].tolist(), strict=True):
            if y != done:
                done, top, who = y, threshold, ""
                match.set_seq2(b.texts[y])
            if most < top or (most == top and a.texts[x] <= who):
                continue
            match.set_seq1(a.texts[x])
            score = match.ratio()
            if score > top or (score == top and a.texts[x] > who):
                top, who, out[y] = score, a.texts[x], x
    return out


def _similar(match: difflib.SequenceMatcher, ready: list, x: str, y: str, threshold: float) -> bool:
    if ready[0] != y:
        ready[0] = y
        match.set_seq2(y)
    match.set_seq1(x)
    return match.ratio() >= threshold


def met(a: Texts, b: Texts, threshold: float) -> np.ndarray:
    """Whether each text of b is similar to one of a."""
    out, match, ready = np.zeros(len(b.texts), bool), difflib.SequenceMatcher(None, autojunk=False), [None]
    for i, j, bound in near(a, b, threshold):
        order = np.lexsort((-bound, j))
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if not out[y] and _similar(match, ready, a.texts[x], b.texts[y], threshold):
                out[y] = True
    return out


def similar(t: Texts, which: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the similar ones among texts, a before b, of some b."""
    match, ready = difflib.SequenceMatcher(None, autojunk=False), [None]
    for i, j, _ in near(t, t.some(which), threshold, which):
        fit = np.array([_similar(match, ready, t.texts[x], t.texts[y], threshold) for x, y in zip(i.tolist(), which[j].tolist(), strict=True)], bool)
        yield i[fit], which[j[fit]]


def removed(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of n texts those that are similar to an earlier one that is not removed; (a, b) are similar, a before b."""
    gone, order = np.zeros(n, bool), np.argsort(b, kind="stable")
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if not gone[x]:
            gone[y] = True
    return np.flatnonzero(gone)
