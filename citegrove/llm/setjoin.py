"""All similar pairs between set-valued records.

Records with the same set form a class; classes are joined, then their members. Candidate classes share one of their
rarest items (a prefix of the set in the order of frequency, which no similar pair can avoid), lie within the length
and position bounds of the threshold, and have one-bit minhash codes within a Hamming radius that is calibrated to
the wanted recall; then the sets themselves are compared. An item in many prefixes has its list dealt into blocks,
each two of which meet in a task of their own (see meetings).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.functions.text import field_values
from citegrove.plans import tables
from citegrove.plans.tables import cut, meetings, salted_join

#: Bits of a code, as WORDS 64-bit words.
WORDS = 4
BITS = 64 * WORDS
#: Part of the similar pairs that the radius may miss.
MISS = 1e-7
#: Items in this many sets at most are equally rare in the order of the prefixes.
FEW = 8
#: Up to this many items in over FEW sets (counted first) their frequencies are broadcast; beyond it they are joined.
RANKED = 200_000


def radius(threshold: float, bits: int = BITS, miss: float = MISS) -> int:
    """The least r such that codes of a pair at the threshold differ in more than r bits with probability ``miss`` at most.

    One-bit minhashes of sets of similarity J differ with probability (1 - J) / 2 each.
    """
    p, tail, r = (1 - threshold) / 2, 1.0, -1
    while tail > miss and r < bits:
        r += 1
        tail -= math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
    return r


def codes(starts: np.ndarray, items: np.ndarray) -> np.ndarray:
    """(sets, WORDS) codes of the non-empty sets whose 64-bit items begin at ``starts``."""
    rng = np.random.default_rng(20_240_229)
    factors, adds = rng.integers(1 << 62, 1 << 63, BITS, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BITS, np.uint64)
    mixed = items.view(np.uint64)
    out = np.zeros((len(starts), WORDS), np.uint64)
    for k in range(BITS):
        x = mixed * factors[k] + adds[k]
        x ^= x >> np.uint64(29)
        least = np.minimum.reduceat(x * np.uint64(0xBF58476D1CE4E5B9), starts)
        out[:, k // 64] |= ((least >> np.uint64(17)) & np.uint64(1)) << np.uint64(k % 64)
    return out.view(np.int64)


def overlap_needed(threshold: float, a: int, b: int) -> float:
    return threshold / (1 + threshold) * (a + b)


def similar_classes(classes: DataFrame, threshold: float, miss: float = MISS) -> DataFrame:
    """(a, b) with a < b of classes (cls, items: distinct 64-bit items, not empty) whose Jaccard similarity is at least the threshold."""
    spark = classes.sparkSession
    frequency = classes.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    frequent = frequency.filter(F.col("n") > FEW).limit(RANKED + 1).collect()
    hot = None
    if len(frequent) <= RANKED:
        by_item = sorted((r.item, r.n) for r in frequent)
        hot = spark.sparkContext.broadcast((np.array([i for i, _ in by_item], np.int64), np.array([n for _, n in by_item], np.int64)))
        lists = classes.select("cls", "items")
    else:
        each = salted_join(classes.select("cls", F.explode("items").alias("item")), cut(frequency, "frequency"), ["item"], "n")
        ranked = F.array_sort(F.collect_list(F.struct("item", "n")))  # one set's items
        lists = each.groupBy("cls").agg(ranked.alias("r")).select("cls", F.col("r.item").alias("items"), F.col("r.n").alias("rarity"))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(1)
            sizes = np.diff(sets.offsets.to_numpy())
            if not len(sizes):
                continue
            items, ids = sets.flatten().to_numpy(), batch.column(0).to_numpy()
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            code = codes(starts, items)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rarity = np.zeros(len(items), np.int64)
            if hot is None:
                rarity = batch.column(2).flatten().to_numpy()
                rarity = np.where(rarity > FEW, rarity, 0)
            elif len(hot.value[0]):
                at = np.minimum(np.searchsorted(hot.value[0], items), len(hot.value[0]) - 1)
                rarity = np.where(hot.value[0][at] == items, hot.value[1][at], 0)
            order = np.lexsort((items, rarity, owner))
            place = np.arange(len(items)) - starts[owner]
            prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            keep = place < prefix[owner]
            o = owner[keep]
            columns = [items[order][keep], ids[o], sizes[o].astype(np.int32), place[keep].astype(np.int32), *(code[o, w] for w in range(WORDS))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["item", "cls", "size", "place", *(f"code{w}" for w in range(WORDS))]
    posted = cut(lists.mapInArrow(postings, "item long, cls long, size int, place int, " + ", ".join(f"code{w} long" for w in range(WORDS))), "postings")
    least = threshold / (1 + threshold) * (F.col("a.size") + F.col("b.size"))
    apart = sum((F.bit_count(F.col(f"a.code{w}").bitwiseXOR(F.col(f"b.code{w}"))) for w in range(WORDS)), F.lit(0))
    near = (
        (F.least("a.size", "b.size") >= threshold * F.greatest("a.size", "b.size") - 1e-9)
        & (F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) >= least - 1e-9)
        & (apart <= radius(threshold, miss=miss))
    )
    found = cut(meetings(posted, ["item"], "cls").filter(near).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct(), "near")
    sets = classes.select("cls", "items")
    both = found.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b")), "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.filter(common >= threshold * (F.size("items_a") + F.size("items_b") - common) - 1e-9).select("a", "b")


class SetJoin:
    """Similar pairs of rows (id, values array<string>) with at least ``least`` distinct values.

    Rows with fewer or null values, or a null id, take no part. Ids should be unique: a repeated one gives its pairs as
    often as it occurs, never one with itself.
    """

    def __init__(self, sets: DataFrame, threshold: float = 0.6, least: int = 5, miss: float = MISS) -> None:
        items = F.array_sort(F.transform(F.array_distinct("values"), lambda x: F.xxhash64(x)))
        rows = sets.filter("id is not null").select("id", items.alias("items")).filter(F.size("items") >= least)
        rows = cut(rows.select("id", "items", F.xxhash64(F.lit("s1"), "items").alias("k1"), F.xxhash64(F.lit("s2"), "items").alias("k2")), "sets")  # sets are read once
        groups = rows.groupBy("k1", "k2").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("rows"), F.any_value("items").alias("items"))
        self.classes = cut(groups, "classes")
        self._rows, self._threshold, self._miss = rows, threshold, miss

    def members(self) -> DataFrame:
        """(id, cls): the class of every row, named by its smallest id. Classes may be hot; the join is salted."""
        return salted_join(self._rows.select("id", "k1", "k2"), self.classes.select("k1", "k2", "cls", "rows"), ["k1", "k2"], "rows").select("id", "cls")

    def class_pairs(self) -> DataFrame:
        return similar_classes(self.classes, self._threshold, self._miss)

    def links(self) -> DataFrame:
        """(id, cls, class_rows, links): one row per record with its class and its number of similar records."""
        pairs = self.class_pairs()
        size = self.classes.select(F.col("cls").alias("other"), F.col("rows").alias("other_rows"))
        ends = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("a").alias("other")))
        outside = ends.join(size, "other").groupBy("cls").agg(F.sum("other_rows").alias("outside"))
        each = self.classes.join(outside, "cls", "left").select("k1", "k2", "cls", "rows", (F.col("rows") - 1 + F.coalesce("outside", F.lit(0))).alias("links"))
        return salted_join(self._rows.select("id", "k1", "k2"), each, ["k1", "k2"], "rows").select("id", "cls", F.col("rows").alias("class_rows"), "links")

    def pairs(self) -> DataFrame:
        """(rec_a, rec_b), rec_a < rec_b: every similar pair of rows, expanded from pairs of classes.

        Its size is that of the result; where many rows are equal, ``links`` or ``class_pairs`` say the same in less.
        Classes are dealt into blocks of PAIR_ROWS rows, so that no task expands more than one pair of blocks at a time.
        """
        blocks = F.ceil(F.col("rows") / tables.PAIR_ROWS).cast("int")
        members = salted_join(self._rows.select("id", "k1", "k2"), self.classes.select("k1", "k2", "cls", "rows"), ["k1", "k2"], "rows")
        members = cut(members.select("id", "cls", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")), "members")
        count = self.classes.select("cls", blocks.alias("n"))
        within = self.classes.filter("rows > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
        both = self.class_pairs().unionByName(within)
        both = both.join(count.select(F.col("cls").alias("a"), F.col("n").alias("na")), "a").join(count.select(F.col("cls").alias("b"), F.col("n").alias("nb")), "b")
        both = both.select("a", "b", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"))
        both = both.select("a", "b", "i", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(F.lit(0)), F.col("nb") - 1)).alias("j"))
        one = members.select(F.col("id").alias("x"), F.col("cls").alias("a"), F.col("block").alias("i"))
        two = members.select(F.col("id").alias("y"), F.col("cls").alias("b"), F.col("block").alias("j"))
        once = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
        pairs = both.join(one, ["a", "i"]).join(two, ["b", "j"]).filter(F.when(once, F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
        return pairs.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))


def reference_sets(records: DataFrame) -> DataFrame:
    return records.select(F.col("rec_id").alias("id"), field_values("refs", "refs").alias("values"))
