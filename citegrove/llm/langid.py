"""Languages of texts and of the paragraphs of mixed ones.

A sparse multinomial logistic regression on TF-IDF weighted character n-grams (1 to 3) is trained with follow the
regularised leader and elastic-net penalties on a bounded sample of labelled rows, cleaned of rows whose label it
rejects, trained again, and calibrated by a temperature on rows held out. Document frequencies cover all texts.

Letters map to 63 symbols and everything else to a blank, so an n-gram is an exact index and needs no hash. Since the
model is linear in relative frequencies, the weights of all three orders and the IDF fold into one table by trigram,
and a text of any length is scored with one lookup per letter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.llm.labels import LANGUAGES, label_code

#: Letters beyond a to z that have a symbol of their own; any other letter shares one (fixed values).
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
SIZES = (1 << 6, 1 << 12, 1 << 18)
STARTS = (0, SIZES[0], SIZES[0] + SIZES[1])
FEATURES = sum(SIZES)


def _symbols() -> np.ndarray:
    table = np.zeros(0x3000, np.uint8)
    for c in range(0x3000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = 1 + LETTERS.index(low) if low in LETTERS else 62
        elif 0x300 <= c < 0x370 or c in (0xAD, 0x200B, 0x200C, 0x200D):
            table[c] = 255  # marks on a letter, and what has no width, are skipped
    return table


SYMBOLS = _symbols()


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram numbers of all texts, start of each text and the end); blanks are collapsed, each text begins and ends with one."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = SYMBOLS[np.minimum(points, 0x2FFF)]
    ends = np.cumsum([len(t) + 1 for t in texts])  # after each text's line end
    keep = symbols != 255
    keep[1:] &= (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[ends - 1] = True
    kept = symbols[keep].astype(np.int32)
    at = np.cumsum(keep)[ends - 1]
    if not len(kept):
        return kept, np.zeros(len(texts) + 1, np.int64)
    before = np.r_[np.int32(0), kept[:-1]]
    return (np.r_[np.int32(0), before[:-1]] << 12) | (before << 6) | kept, np.r_[0, at]


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all orders of one text and their relative frequencies within the order."""
    found, shares = [], []
    for start, shift in zip(STARTS, (2, 1, 0), strict=True):
        mask = (1 << 6 * (3 - shift)) - 1
        gram, n = np.unique(codes & mask, return_counts=True)
        found.append(gram + start)
        shares.append(n / len(codes))
    return np.concatenate(found), np.concatenate(shares)


@dataclass
class Model:
    """``table``: (trigrams, languages) folded weights; ``bias``; ``temperature``; held-out accuracy."""

    table: np.ndarray
    bias: np.ndarray
    temperature: float
    accuracy: float

    def logits(self, texts: list[str]) -> np.ndarray:
        codes, at = trigrams(texts)
        out = np.zeros((len(texts), len(LANGUAGES)))
        for low in range(0, len(texts), 512):  # bounded memory for the weights looked up
            high = min(low + 512, len(texts))
            a, b = at[low], at[high]
            for piece in range(a, b, 1 << 20):
                end = min(piece + (1 << 20), b)
                found = self.table[codes[piece:end]]
                inner = np.clip(at[low : high + 1], piece, end) - piece
                filled = inner[1:] > inner[:-1]
                if filled.any():
                    out[low:high][filled] += np.add.reduceat(found, inner[:-1][filled], axis=0)
        return out / np.maximum(at[1:] - at[:-1], 1)[:, None] + self.bias

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and calibrated confidence of each text."""
        if not texts:
            return np.zeros(0, int), np.zeros(0)
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 3, alpha: float = 1.0, beta: float = 0.05, l1: float = 0.02, l2: float = 0.01, batch: int = 64, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net on sparse rows (n-grams, values): weights (FEATURES, languages) and bias."""
    k = len(LANGUAGES)
    z, n = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))
    bias, rng = np.zeros(k), np.random.default_rng(seed)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        step = (beta + np.sqrt(n[at])) / alpha + l2
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0) / step

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), batch):
            part = order[low : low + batch]
            grams = np.concatenate([rows[i][0] for i in part])
            values = np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            used, local = np.unique(grams, return_inverse=True)
            w = weights(used)
            scores = np.stack([np.bincount(owner, values * w[local, c], len(part)) for c in range(k)], 1) + bias
            error = _softmax(scores)
            error[np.arange(len(part)), labels[part]] -= 1
            g = np.stack([np.bincount(local, values * error[owner, c], len(used)) for c in range(k)], 1)
            grown = n[used] + g * g
            z[used] += g - (np.sqrt(grown) - np.sqrt(n[used])) / alpha * w
            n[used] = grown
            bias -= 0.01 * error.mean(0)
    return weights(slice(None)), bias


def train(texts: list[str], labels: list[str], idf: np.ndarray) -> Model:
    """Train, drop rows whose label has less than even odds, train again; a sixth of the rows is held out for the temperature."""
    codes, at = trigrams(texts)
    y = np.array([LANGUAGES.index(x) for x in labels])
    rows = []
    for i in range(len(texts)):
        grams, shares = _features(codes[at[i] : at[i + 1]])
        rows.append((grams, shares * idf[grams]))
    held = np.arange(len(texts)) % 6 == 5
    learn = np.flatnonzero(~held)
    weights, bias = fit([rows[i] for i in learn], y[learn])
    model = _folded(weights, bias, idf)
    trusted = _softmax(model.logits(texts))[np.arange(len(y)), y] >= 0.5
    learn = np.flatnonzero(~held & trusted)
    if len(np.unique(y[learn])) > 1:
        weights, bias = fit([rows[i] for i in learn], y[learn], seed=2)
        model = _folded(weights, bias, idf)
    test = np.flatnonzero(held & trusted)
    if len(test):
        whole = [texts[i] for i in test]
        parts = [s for i in test for s in _SENTENCES.split(texts[i])[:3]]
        part_y = [y[i] for i in test for _ in _SENTENCES.split(texts[i])[:3]]
        scores, truth = model.logits(whole + parts), np.r_[y[test], part_y].astype(int)
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(_softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        model.accuracy = float((scores[: len(test)].argmax(1) == y[test]).mean())
    return model


def _folded(weights: np.ndarray, bias: np.ndarray, idf: np.ndarray) -> Model:
    w = weights * idf[:, None]
    gram = np.arange(SIZES[2])
    table = w[STARTS[2] + gram] + w[STARTS[1] + (gram & 0xFFF)] + w[STARTS[0] + (gram & 0x3F)]
    return Model(table.astype(np.float32), bias, 1.0, float("nan"))


_SENTENCES = regex.compile(r"(?<=[.!?])\s+")


#: Rows of a sample: their text's shortest and longest number of characters.
SAMPLE_CHARS = (100, 4_000)


def sample_bound(per_language: int, rows: int) -> int:
    """The 64-bit hash below which rows of a language are drawn, so that about ``per_language`` of its ``rows`` are, however many there are."""
    return (1 << 63) - 1 if rows <= per_language else -(1 << 63) + (1 << 64) * per_language // rows


def counted_and_drawn(texts: DataFrame, per_language: int) -> tuple[np.ndarray, int, list[tuple[str, str]]]:
    """Texts that have each n-gram, over all rows; the number of texts; and the labelled sample as (text, label).

    One pass over the texts does both, after one over the labels. About ``per_language`` rows are drawn of each language
    by a 64-bit hash, of which those of SAMPLE_CHARS characters are used. What reaches the driver is bounded: a row per
    n-gram and the sample.
    """
    labelled = texts.filter(F.col("label").isin(*LANGUAGES)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()  # reads no text; at most a row per language
    mixed = F.xxhash64("kind", "id", F.lit("sample"))
    drawn = F.lit(False)
    for r in labelled:
        drawn = F.when(F.col("label") == r.label, mixed <= sample_bound(per_language, r.n)).otherwise(drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        last = np.zeros(SIZES[2], np.int32)
        names = ["gram", "n", "text", "label"]
        for batch in batches:
            every = batch.column(0).to_pylist()
            values = [t for t in every if t]
            codes, at = trigrams(values) if values else (np.zeros(0, np.int32), np.zeros(1, np.int64))
            for i in range(len(values)):
                c = codes[at[i] : at[i + 1]]
                places = np.arange(len(c), dtype=np.int32)
                last[c] = places
                three = c[last[c] == places]  # each n-gram at its last place
                two = np.unique(three & 0xFFF)
                seen[STARTS[2] + three] += 1
                seen[STARTS[1] + two] += 1
                seen[np.unique(two & 0x3F)] += 1
            n += len(values)
            picked = [(h, t, y) for t, y, h in zip(every, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) if h is not None and t and SAMPLE_CHARS[0] <= len(t) <= SAMPLE_CHARS[1]]
            if picked:
                h, t, y = zip(*picked, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.nulls(len(h), pa.int64()), pa.array(t), pa.array(y)], names)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, FEATURES]), pa.array(np.r_[seen[used], n]), pa.nulls(len(used) + 1, pa.string()), pa.nulls(len(used) + 1, pa.string())], names)

    found = texts.select("text", "label", F.when(drawn, F.xxhash64("kind", "id")).alias("h")).mapInArrow(count, "gram long, n long, text string, label string")
    got = found.groupBy("gram", "text", "label").agg(F.sum("n").alias("n")).toPandas()
    grams, sample = got[got["text"].isna()], got[got["text"].notna()]
    all_n = np.zeros(FEATURES + 1, np.int64)
    all_n[grams["gram"]] = grams["n"]
    rows = sorted(zip(sample["gram"], sample["text"], sample["label"], strict=True))
    return all_n[:-1], int(all_n[-1]), [(t, y) for _, t, y in rows]


def trained(texts: DataFrame, per_language: int = 1_000) -> Model | None:
    """A model from texts (kind, id, text, label): bounded labelled sample (``per_language``), IDF over all rows. None without labels."""
    df, n, sample = counted_and_drawn(texts, per_language)
    if not sample:
        return None
    return train([t for t, _ in sample], [y for _, y in sample], np.log((1 + n) / (1 + df)) + 1)


#: Confidence under which a paragraph without running sentences gets the main language of its document and has no say in whether that is mixed.
SURE = 0.8
_LINE = regex.compile(r"[\n\r]+")
PARAGRAPHS = regex.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+")
_SENTENCE = re.compile(r"""(?:(?<=[^\W\d_][^\W\d_])|(?<=[^\W\d_][^\W\d_]["'”’»)\]]))[.!?…]["'”’»)\]]*(?:\s|\Z)|[?!](?:\s|\Z)""")
#: Any end of a sentence: after numbers, single letters and brackets too.
_ANY_END = re.compile(r"""[^\W_]["'”’»)\]]*[.!?…]["'”’»)\]]*(?:\s|\Z)""")
_FIVE_WORDS = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]+[\W\d_]+){4}[^\W\d_]")


def running(line: str) -> bool:
    """Whether a line has running sentences: a sentence's end and five words."""
    return bool(_SENTENCE.search(line) and _FIVE_WORDS.search(line))


def prose(text: str) -> bool:
    """Whether a paragraph is sentences in a wider sense: any sentence's end and five words, or eight words and few marks."""
    return bool(_ANY_END.search(text) and _FIVE_WORDS.search(text)) or _wordy(text)


def lines_of(text: str) -> list[str]:
    """The lines judged: those with running sentences; if there are none, lines of eight words and few marks."""
    lines = [x for x in _LINE.split(text) if x.strip()]
    return [x for x in lines if running(x)] or [x for x in lines if _wordy(x)]


def _wordy(line: str) -> bool:
    parts = line.split()
    return len(parts) >= 8 and sum(p.strip(".,;:!?()'\"").isalpha() for p in parts) * 3 >= len(parts) * 2 and sum(map(line.count, ",;:/|=")) * 6 < len(parts)


def judge_many(model: Model | None, texts: list[str]) -> list[tuple[int, float]]:
    """(language number or -1, confidence) of each text: of its judged lines the language of most letters."""
    if model is None:
        return [(-1, 0.0)] * len(texts)
    lines, owner = [], []
    for i, t in enumerate(texts):
        found = lines_of(t)
        lines += found
        owner += [i] * len(found)
    best, sure = model.judge(lines)
    weight = np.zeros((len(texts), len(LANGUAGES), 2))
    for i, line, b, s in zip(owner, lines, best, sure, strict=True):
        weight[i, b] += (len(line), len(line) * s)
    total = weight[:, :, 0].sum(1)
    main = weight[:, :, 0].argmax(1)
    at = np.arange(len(texts))
    return [(int(m), float(s / n)) if n else (-1, 0.0) for m, s, n in zip(main, weight[at, main, 1], total, strict=True)]


def _judged(model: Callable[[], Model], least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["item_kind", "item_id", "seg_no", "lang", "confidence", "label", "mixed", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for whole in batches:
            for low in range(0, whole.num_rows, 1_000):
                batch = whole.slice(low, 1_000)
                kinds, ids, texts, labels = (batch.column(i).to_pylist() for i in range(4))
                verdicts = judge_many(m, [t or "" for t in texts])
                rows: list[tuple] = []
                parts, owner = [], []
                for i, (kind, t) in enumerate(zip(kinds, texts, strict=True)):
                    found = [p for p in PARAGRAPHS.split(t.strip()) if p.strip()] if t and kind == "document" and labels[i] not in ("zh", "zxx") else []
                    if sum(len(p.strip()) >= least for p in found) > 1:
                        parts += found
                        owner += [i] * len(found)
                of_parts = judge_many(m, parts)
                bare, bare_sure = m.judge(parts) if m else ([], [])
                by_owner: dict[int, list[int]] = {}
                for k, i in enumerate(owner):
                    by_owner.setdefault(i, []).append(k)
                mixed: dict[int, list[int]] = {}
                for i, ks in by_owner.items():
                    said = set()
                    for k in ks:
                        if len(parts[k].strip()) >= least:
                            if running(parts[k]):
                                said.add(of_parts[k][0])
                            elif m and bare_sure[k] >= SURE and prose(parts[k]):
                                said.add(int(bare[k]))
                    if len(said - {-1}) > 1:
                        mixed[i] = ks
                for i in range(len(ids)):
                    language, sure = verdicts[i]
                    rows.append((kinds[i], ids[i], 0, LANGUAGES[language] if language >= 0 else None, sure, labels[i], i in mixed, len(texts[i] or "")))
                    for no, k in enumerate(mixed.get(i, []), 1):
                        language, sure = of_parts[k] if running(parts[k]) else (int(bare[k]), float(bare_sure[k]))
                        if sure < SURE and not running(parts[k]) and verdicts[i][0] >= 0:
                            language = verdicts[i][0]  # headings and lists go with their document
                        rows.append((kinds[i], ids[i], no, LANGUAGES[language], sure, labels[i], True, len(parts[k])))
                if rows:
                    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def languages(texts: DataFrame, model: Model | None, least: int = 60) -> DataFrame:
    """(item_kind, item_id, seg_no, lang, confidence, label, mixed, chars) of texts (kind, id, text, label).

    seg_no 0 is the whole text; paragraphs are numbered from 1, and given for documents in which paragraphs of
    ``least`` characters differ. ``lang`` is null for texts without running words (null and empty ones too), and for all
    texts without a model.
    """
    held = texts.sparkSession.sparkContext.broadcast(model)  # of fixed size: a row per trigram
    schema = "item_kind string, item_id long, seg_no long, lang string, confidence double, label string, mixed boolean, chars long"
    return texts.select("kind", "id", "text", "label").mapInArrow(_judged(lambda: held.value, least), schema)


def corpus_texts(records: DataFrame, documents: DataFrame, abstract: Column) -> DataFrame:
    """(kind, id, text, label) of both tables; label is a code or null."""
    one = records.select(F.lit("record").alias("kind"), F.col("rec_id").alias("id"), abstract.alias("text"), label_code("language").alias("label"))
    two = documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", label_code("lang").alias("label"))
    return one.unionByName(two)


def wrong_or_missing(judged: DataFrame, least: int = 100) -> DataFrame:
    """Of ``languages``' rows: whole texts of ``least`` characters whose label is missing or another, and all paragraphs of mixed documents.

    Texts labelled zh or zxx, and texts without running words, are no cases.
    """
    wrong = (F.col("chars") >= least) & ~F.coalesce(F.col("label"), F.lit("")).isin("zh", "zxx") & ~F.col("label").eqNullSafe(F.col("lang"))
    return judged.filter(F.col("lang").isNotNull() & ((F.col("seg_no") > 0) | wrong))
