"""Items that appear together: blocked sparse Gram matrices, counts against the expected marginals.

A basket is the set of items of one field of one record. Null and empty fields make no basket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.functions.text import field_values
from citegrove.plans.tables import cut, fits, salted_join

FIELDS = ("keywords", "authors", "refs")
#: Items of a record block, pairs made at once from it, and the items of the block that occur most and are multiplied densely.
BLOCK_ITEMS, BLOCK_PAIRS, DENSE = 400_000, 4_000_000, 128


def baskets(records: DataFrame) -> DataFrame:
    """(id, field, items): the distinct items of each field of each record that has any. Every row is a basket of its own,
    numbered by its place, so null and repeated ids do no harm."""
    sets = F.array(*(F.struct(F.lit(f).alias("field"), F.array_distinct(field_values(f, f)).alias("items")) for f in FIELDS))
    return records.select(F.monotonically_increasing_id().alias("id"), F.inline(sets)).filter(F.size("items") > 0)


def transpose_product(starts: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The upper triangle of X'X as (i, j, count), in parts, for the sparse binary record block X.

    Row r of X has the columns items[starts[r] : starts[r + 1]]. Columns are put in the order of their frequency in
    the block. The block of the first DENSE ones is multiplied densely; of the others each entry of a row is
    multiplied with those after it, and products of equal place are summed, BLOCK_PAIRS of them at a time.
    """
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    used, local, often = np.unique(items, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(used), np.int64)
    rank[order] = np.arange(len(used))
    used, column = used[order], rank[local]
    by = np.lexsort((column, row))
    column = column[by]
    if len(lengths) > DENSE:
        dense = column < DENSE
        x = np.zeros((len(lengths), min(DENSE, len(used))), np.float32)
        x[row[dense], column[dense]] = 1
        gram = np.triu(x.T @ x, 1)  # exact: a block has under 2 ** 24 rows
        i, j = np.nonzero(gram)
        if len(i):
            yield used[i], used[j], gram[i, j].astype(np.int64)
        hot = np.bincount(row[dense], minlength=len(lengths))[row]
    else:
        hot = np.zeros(len(column), np.int64)
    place = np.arange(len(column)) - starts[:-1][row]
    first = np.maximum(place + 1, hot)  # the place of the first entry to multiply with
    pairs = np.maximum(lengths[row] - first, 0)
    upto = np.r_[0, np.cumsum(pairs)]
    low = 0
    while low < len(pairs):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + BLOCK_PAIRS, "right")) - 1)
        n = pairs[low:high]
        left = np.repeat(column[low:high], n)
        right = column[np.arange(n.sum()) - np.repeat(upto[low:high] - upto[low], n) + np.repeat((starts[:-1][row] + first)[low:high], n)]
        code, count = np.unique(left << 32 | right, return_counts=True)
        if len(code):
            yield used[code >> 32], used[code & 0xFFFFFFFF], count
        low = high


def gram_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (basket, item), the items of a basket together, to partial counts (a, b, n) with a < b."""
    names = ["a", "b", "n"]

    def counted(baskets: np.ndarray, items: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, baskets[1:] != baskets[:-1], True])
        for a, b, n in transpose_product(starts, items):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n)], names)

    held_b, held_i, held = [], [], 0
    for batch in batches:
        held_b.append(batch.column(0).to_numpy())
        held_i.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= BLOCK_ITEMS:
            b, i = np.concatenate(held_b), np.concatenate(held_i)
            last = int(np.searchsorted(b[::-1] != b[-1], True))  # items of the basket that may go on
            if last < len(b):
                yield from counted(b[: len(b) - last], i[: len(i) - last])
            held_b, held_i, held = [b[len(b) - last :]], [i[len(i) - last :]], last
    if held:
        yield from counted(np.concatenate(held_b), np.concatenate(held_i))


def together(sets: DataFrame, least: int = 10, lift: float = 8.0) -> DataFrame:
    """field, item_a, item_b, n_a, n_b, n_ab, n, lift of pairs in ``least`` baskets and ``lift`` times as often as by chance.

    ``sets`` has id, field and items (distinct); it is read once and written to the shared folder. item_a < item_b by
    code point. Only items that can be part of such a pair are numbered: since n_ab is at most n_a and n_b, both must
    be in ``least`` baskets, and neither in more than n / lift. Item counts, basket counts (those of the item null) and
    pair counts are combined in the map tasks before each shuffle, so a hot item is one row per task. The numbered items
    are broadcast while they are few and small (see fits); beyond that salted joins are used.
    """
    sets = cut(sets.select("id", "field", F.filter("items", lambda x: x.isNotNull()).alias("items")).filter(F.size("items") > 0), "baskets")
    every = F.concat("items", F.array(F.lit(None).cast("string")))
    counts = sets.select("field", F.explode(every).alias("item")).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n_item"))
    counts = cut(counts.filter((F.col("n_item") >= least) | F.col("item").isNull()), "counts")
    sizes = counts.filter("item is null").select("field", F.col("n_item").alias("n"))  # a row per field
    usable = counts.filter("item is not null").join(F.broadcast(sizes), "field").filter(F.col("n_item") * lift <= F.col("n"))
    # the numbers are fixed once they are written
    words = cut(usable.select(F.monotonically_increasing_id().alias("no"), "field", "item", "n_item", "n"), "items")
    small = fits(words)
    numbers, basket = words.select("field", "item", "n_item", "no"), F.xxhash64("field", "id").alias("basket")
    items = sets.select("id", "field", F.explode("items").alias("item"))
    if small:  # the items of a basket stay together in their partition
        numbered = items.join(F.broadcast(numbers), ["field", "item"]).select(basket, "no")
    else:
        numbered = salted_join(items, numbers, ["field", "item"], "n_item").select(basket, "no")
        numbered = numbered.repartition("basket").sortWithinPartitions("basket")
    pairs = numbered.mapInArrow(gram_blocks, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n_ab")).filter(F.col("n_ab") >= least)
    if not small:
        pairs = cut(pairs, "pairs")
    for side in ("a", "b"):
        names = words.select(F.col("no").alias(side), F.col("item").alias(f"item_{side}"), F.col("n_item").alias(f"n_{side}"), *(["field", "n"] if side == "a" else []))
        if small:
            pairs = pairs.join(F.broadcast(names), side)
        else:
            named = cut(names.join(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_pairs")), side), "named")
            pairs = cut(salted_join(pairs, named, [side], "_pairs").drop("_pairs"), "pairs", instead_of=pairs)
    pairs = pairs.filter(F.col("n_ab") * F.col("n") >= lift * F.col("n_a") * F.col("n_b"))
    swap = F.col("item_a") > F.col("item_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    return pairs.select("field", pick("item_a", "item_b"), pick("item_b", "item_a"), pick("n_a", "n_b"), pick("n_b", "n_a"), "n_ab", "n", (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"))


def record_pairs(records: DataFrame, least: int = 10, lift: float = 8.0) -> DataFrame:
    return together(baskets(records.select(*FIELDS)), least, lift)
