"""Networks as node and edge DataFrames; edges are undirected with src < dst unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrove.functions.text import first_surname, normalised_doi, year_of
from citegrove.operators.corpus import counts, items, relevance
from citegrove.plans.tables import cut, fits, lookup_join, numbered_rows, salted_join

#: Records of a block of coupling, and pairs of them that a task counts at a time.
COUPLED_ROWS, COUPLED_PAIRS = 100_000, 2_000_000


def pair_weights(docs: DataFrame, value: str = "item", counting: str = "full", dedup: bool = True) -> DataFrame:
    """(src, dst, weight) of values that share a document of ``docs`` (rec_id, value).

    Values of a document are gathered once (a document's list is bounded by its own size) and paired within the row,
    so that the only shuffle after it carries pair counts already combined in the map tasks. ``counting``: full adds 1
    per document, fractional 1 / (values of the document). Without ``dedup`` repeats count and may give src = dst.
    """
    gather = F.collect_set if dedup else F.collect_list
    lists = docs.groupBy("rec_id").agg(F.array_sort(gather(value)).alias("v"))
    n = F.size("v")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.slice("v", i + 1, n - i), lambda y: F.struct(F.element_at("v", i).alias("src"), y.alias("dst")))))
    each = lists.filter(n > 1).select(F.inline(pairs), (1.0 / n).alias("share") if counting == "fractional" else F.lit(1).alias("share"))
    return each.groupBy("src", "dst").agg((F.round(F.sum("share"), 4) if counting == "fractional" else F.sum("share")).alias("weight"))


def among(docs: DataFrame, value: str, allowed: DataFrame, weight: str) -> DataFrame:
    """Rows of docs whose value is one of ``allowed`` (value, weight = rows that have it): broadcast while they are few, hot values salted beyond."""
    return lookup_join(docs, cut(allowed.select(value, weight), "allowed"), [value], weight).drop(weight)


def term_nodes(terms: DataFrame, min_occurrence: int = 1, max_nodes: int | None = None, allowed: DataFrame | None = None, top_percent: float | None = None) -> DataFrame:
    """(term, occurrences, doc_freq, relevance) of the valid terms: enough occurrences, allowed, then the most relevant.

    How many are kept is said by ``max_nodes``, or else by ``top_percent`` of the terms with enough occurrences (one at least).
    """
    nodes = relevance(counts(terms), terms).filter(F.col("occurrences") >= min_occurrence)
    if top_percent is not None and max_nodes is None:
        max_nodes = max(1, int(nodes.count() * top_percent / 100))
    if allowed is not None:
        nodes = nodes.join(allowed.select("term").distinct(), "term", "left_semi")
    if max_nodes is not None:
        nodes = nodes.orderBy(F.desc("relevance"), "term").limit(max_nodes)
    return nodes


def cooccurrence(terms: DataFrame, nodes: DataFrame, counting: str = "full") -> DataFrame:
    """Edges between valid terms of the same document."""
    return pair_weights(among(terms, "term", nodes, "occurrences").select("rec_id", F.col("term").alias("item")), counting=counting)


def numbered_cooccurrence(terms: DataFrame, min_occurrence: int = 1) -> tuple[DataFrame, DataFrame]:
    """(no, term) of the terms with enough occurrences, numbered by name, and cooccurrence's edges between these numbers."""
    nodes = cut(terms.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") >= min_occurrence), "nodes")
    blocks = min(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + nodes.count() // 20_000)
    names = cut(numbered_rows(nodes, [F.asc("term")], "no", blocks), "names")
    docs = lookup_join(terms.select("rec_id", "term"), names.select("term", "occurrences", "no"), ["term"], "occurrences").select("rec_id", "no")
    return names.select("no", "term"), cut(pair_weights(docs, "no"), "edges")


def association_strength(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """weight = raw / (occ_src * occ_dst / total), total over all terms; the raw weight is kept as weight_raw."""
    occ = terms.groupBy("term").agg(F.count(F.lit(1)).alias("occ"))
    total = terms.agg(F.count(F.lit(1)).alias("total"))  # one row
    a, b = occ.select(F.col("term").alias("src"), F.col("occ").alias("occ_a")), occ.select(F.col("term").alias("dst"), F.col("occ").alias("occ_b"))
    w = F.col("weight") / (F.col("occ_a") * F.col("occ_b") / F.col("total"))
    return edges.join(a, "src").join(b, "dst").crossJoin(F.broadcast(total)).select("src", "dst", F.round(w, 6).alias("weight"), F.col("weight").alias("weight_raw"))


def valued_edges(c: DataFrame, field: str, sep: str, min_count: int, counting: str = "full", dedup: bool = True, map_item: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a listed field: nodes (item, n) with at least ``min_count`` occurrences, edges among them."""
    each = items(c, field, sep)
    if map_item is not None:
        each = each.withColumn("item", map_item)
    nodes = each.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    return nodes, pair_weights(among(each, "item", nodes, "n"), counting=counting, dedup=dedup)


def coauthorship(c: DataFrame, min_publications: int = 1, counting: str = "full", dedup: bool = True) -> tuple[DataFrame, DataFrame]:
    return valued_edges(c, "authors", "auto", min_publications, counting, dedup)


def cocitation(c: DataFrame, least: int = 2) -> DataFrame:
    """References cited together by at least ``least`` records. Both must then be cited that often, so others are left out first."""
    refs = items(c, "refs", "semicolon", keep=("rec_id",)).select("rec_id", "item")
    once = refs.groupBy("item", "rec_id").agg(F.count(F.lit(1)).alias("rows"))
    usable = once.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).filter(F.col("n") >= least)
    return pair_weights(among(refs, "item", usable, "rows")).filter(F.col("weight") >= least)


def patent_classes(c: DataFrame, min_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """Co-classification by the first four characters of the upper-case codes."""
    return valued_edges(c, "ipc", "semicolon", min_count, map_item=F.substring(F.upper("item"), 1, 4))


def coupling(c: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst, weight): records that share at least ``least`` distinct references.

    Two such records share one even after each has lost its least - 1 most cited references, so pairs are looked for
    among the rest only: the references that a large part of all records cites almost never meet each other. What else
    they share is then added. Records are dealt into blocks of COUPLED_ROWS at most, and each two blocks are one task's,
    which counts their pairs some at a time; no pair is shuffled.
    """
    refs = items(c, "refs", "semicolon", keep=("rec_id",)).select("rec_id", "item").distinct()
    cited = cut(refs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "cited")
    cited = cut(numbered_rows(cited, [F.desc("n"), F.asc("item")], "ref"), "numbered")
    sets = lookup_join(refs, cited, ["item"], "n").groupBy("rec_id").agg(F.sort_array(F.collect_list("ref")).alias("refs"))
    sets = cut(numbered_rows(sets.filter(F.size("refs") >= least), [F.asc("rec_id")], "no"), "sets")
    n, kind = sets.count(), c.schema["rec_id"].dataType.simpleString()
    rows = min(COUPLED_ROWS, max(2_048, -(-n // 12)))
    last, pairs = max(0, -(-n // rows) - 1), max(1, -(-n // rows) * (-(-n // rows) + 1) // 2)

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no")
        return pd.DataFrame({"block": [part["block"].iloc[0]], "ids": [part["rec_id"].tolist()], "size": [part["refs"].map(len).to_numpy(np.int64).tobytes()], "refs": [np.concatenate(part["refs"].to_list()).astype(np.int64).tobytes()]})

    blocks = sets.withColumn("block", F.floor(F.col("no") / rows).cast("int")).select("block", "no", "rec_id", "refs")
    blocks = cut(blocks.groupBy("block").applyInPandas(packed, f"block int, ids array<{kind}>, size binary, refs binary"), "blocks")
    side = lambda x: F.struct("ids", "size", "refs").alias(x)
    one = blocks.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(last))).alias("j"), side("a")).repartition(min(pairs, 1_000), "i", "j")
    two = blocks.select(F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), side("b")).repartition(min(pairs, 1_000), "i", "j")

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                a, b = (part.column(k)[row] for k in (0, 1))
                ids = [x["ids"].values for x in (a, b)]
                arrays = ([np.frombuffer(x[k].as_py(), np.int64) for k in ("size", "refs")] for x in (a, b))
                for i, j, weight in _shared(*arrays, least, part.column(2)[row].as_py()):
                    yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(weight)], ["src", "dst", "weight"])

    return one.join(two, ["i", "j"]).select("a", "b", F.col("i") == F.col("j")).mapInArrow(counted, f"src {kind}, dst {kind}, weight long")


def _shared(a: list[np.ndarray], b: list[np.ndarray], least: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, weight) of the records of two blocks that share ``least`` references; of the ``same`` block, i before j.

    A block is the numbers of references of its records, and these, of each record in order of citations.
    """

    def rows_of(block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(block[0])), block[0])
        return row, np.arange(len(row)) - (np.cumsum(block[0]) - block[0])[row]

    (row, rank), (other, place) = rows_of(a), rows_of(b)
    top = np.full((2, max(least - 1, 0), max(len(a[0]), len(b[0]))), -1, np.int64)  # the most cited references of each record
    lists = []  # of both kinds of references of b: the references in order, and whose they are
    for k, (r, x, refs) in enumerate(((row, rank, a[1]), (other, place, b[1]))):
        most = x < least - 1
        top[k, x[most], r[most]] = refs[most]
        for kind in (~most, most) if k else ():
            order = np.argsort(refs[kind], kind="stable")
            lists.append((refs[kind][order], r[kind][order]))

    def ends(refs: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.searchsorted(lists[kind][0], refs)
        return low, np.searchsorted(lists[kind][0], refs, "right") - low

    def met(rows: np.ndarray, low: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
        return np.repeat(rows, n) * len(b[0]) + lists[kind][1][at]

    rest = rank >= least - 1
    near = [ends(a[1], kind) for kind in (0, 1)]
    work = np.cumsum(np.bincount(row, np.where(rest, near[0][1] + near[1][1], near[0][1]), len(a[0])))
    begin = np.r_[0, np.cumsum(a[0])]
    low = 0
    while low < len(a[0]):
        high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + COUPLED_PAIRS, "right")))
        some = slice(begin[low], begin[high])
        keep = rest[some]
        pick = lambda x, which: x[some][which]  # noqa: E731, B023
        key = np.sort(met(pick(row, keep), pick(near[0][0], keep), pick(near[0][1], keep), 0))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        weight, key = np.diff(np.r_[first, len(key)]), key[first]
        if len(key) and least > 1:
            for which, kind in ((~keep, 0), (keep, 1)):  # a most cited one of either record among the others of the other
                more = met(pick(row, which), pick(near[kind][0], which), pick(near[kind][1], which), kind)
                at = np.minimum(np.searchsorted(key, more), len(key) - 1)
                weight = weight + np.bincount(at[key[at] == more], minlength=len(key))
            i, j = key // len(b[0]), key % len(b[0])
            for x in top[0]:
                for y in top[1]:
                    weight = weight + (x[i] == y[j])
        i, j = key // len(b[0]), key % len(b[0])
        fit = (weight >= least) & (i < j) if same else weight >= least
        if fit.any():
            yield i[fit], j[fit], weight[fit].astype(np.int64)
        low = high


def first_labels(c: DataFrame, width: int = 25) -> DataFrame:
    """(rec_id, label): first author and year, as equal as they come."""
    who = F.substring(F.substring_index("authors", ";", 1), 1, width)
    return c.select("rec_id", F.concat(F.when(F.col("authors") == "", F.lit("Unknown")).otherwise(who), F.lit(" ("), F.col("year").cast("string"), F.lit(")")).alias("label"))


def paper_labels(c: DataFrame, width: int = 25) -> DataFrame:
    """(rec_id, label): first author and year; equal labels are told apart by #1, #2, ... in the order of rec_id."""
    base = first_labels(c, width).withColumnRenamed("label", "base")
    k = F.row_number().over(Window.partitionBy("base").orderBy("rec_id")) - 1
    return base.withColumn("k", k).select("rec_id", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat("base", F.lit(" #"), F.col("k").cast("string"))).alias("label"))


def direct_citations(c: DataFrame) -> DataFrame:
    """(src, dst, how): record src cites record dst, directed, by DOI or else by first surname and year; no self-citations.

    Of records with one DOI (or one surname and year) the last by rec_id is the one cited.
    """
    mine = c.select("rec_id", normalised_doi("doi").alias("d"), first_surname("authors").alias("surname"), "year")
    by_doi = mine.filter("d <> ''").groupBy("d").agg(F.max("rec_id").alias("by_doi"))
    by_name = mine.filter("surname <> '' and year > 0").groupBy("surname", "year").agg(F.max("rec_id").alias("by_name"))
    refs = items(c, "refs", "semicolon", keep=("rec_id",)).select("rec_id", "item")
    # repeated references are read once; what they name is then joined back, hot ones salted
    each = cut(refs.groupBy("item").agg(F.count(F.lit(1)).alias("rows")), "references")
    word = F.lower(F.regexp_extract("item", r"^([^\s,;]+)", 1))
    named = each.select("item", "rows", normalised_doi("item").alias("d"), word.alias("surname"), year_of("item").alias("year"))
    named = named.withColumn("d", F.when(F.col("d") != "", F.col("d"))).withColumn("surname", F.when((F.col("surname") != "") & (F.col("year") > 0), F.col("surname")))
    found = named.join(by_doi, "d", "left").join(by_name, ["surname", "year"], "left")
    how = F.when(F.col("by_doi").isNotNull(), F.lit("doi")).otherwise(F.lit("author_year"))
    found = cut(found.select("item", "rows", F.coalesce("by_doi", "by_name").alias("dst"), how.alias("how")).filter("dst is not null"), "named")
    out = lookup_join(refs, found, ["item"], "rows").select(F.col("rec_id").alias("src"), "dst", "how")
    return out.filter("src <> dst").distinct()


def bipartite(c: DataFrame, least: int = 1) -> DataFrame:
    """(author, keyword, weight): records in which they occur together, repeats counted."""
    a = items(c, "authors", "semicolon", keep=("rec_id",)).select("rec_id", F.col("item").alias("author"))
    k = items(c, "keywords", "semicolon", keep=("rec_id",)).select("rec_id", F.col("item").alias("keyword"))
    return a.join(k, "rec_id").groupBy("author", "keyword").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)


def historiograph(c: DataFrame, top: int = 25) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the ``top`` most cited records: u cites v if it is not older and names v's DOI, or author and year.

    Nodes have a centred place within their year. The self-join is over ``top`` rows.
    """
    first = F.trim(F.substring_index("authors", ";", 1))
    name = F.regexp_replace(F.element_at(F.split(first, r"\s+"), -1), r"[^A-Za-z\-]", "")
    best = c.orderBy(F.desc("citations"), "rec_id").limit(top)
    best = best.select("rec_id", "year", "citations", F.lower("doi").alias("doi"), F.lower("refs").alias("refs"), F.when(name == "", F.lit("Anon")).otherwise(name).alias("author"))
    w = Window.partitionBy("year")
    place = F.row_number().over(w.orderBy(F.desc("citations"), "rec_id")) - (F.count(F.lit(1)).over(w) + 1) / 2.0
    nodes = best.select("rec_id", "author", "year", "citations", place.alias("place"))
    u = best.select(F.col("rec_id").alias("src"), F.col("year").alias("year_u"), "refs")
    v = best.select(F.col("rec_id").alias("dst"), F.col("year").alias("year_v"), "doi", F.lower("author").alias("author"))
    named = ((F.length("doi") > 4) & F.contains("refs", "doi")) | ((F.length("author") > 2) & F.contains("refs", "author") & F.contains("refs", F.col("year_v").cast("string")))
    edges = u.join(F.broadcast(v), (F.col("src") != F.col("dst")) & (F.col("year_u") >= F.col("year_v")) & named)  # top rows by top rows
    return nodes, edges.select("src", "dst")


def overlay(c: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, matched, papers, year_mean, citations_mean, citations_sum) of network nodes.

    A label matches records by keyword, else by author, else by a title that contains it, else by the year and author it
    names, as labels of papers do ("Silva, J (2019)"): records of that year whose authors contain the label without its
    digits and the marks around; a label of digits alone names none. Year 0 is left out of the mean year. Each stage
    looks only for the labels that the ones before leave over, and none where there are none.
    """
    keys = cut(labels.select("label", F.lower("label").alias("k")).distinct(), "labels")
    num = ["rec_id", "year", "citations"]

    def met_by(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows (k, num...) of the wanted labels; ``wanted`` is broadcast while it is small, hot keys are salted beyond."""
        if fits(wanted):
            return rows.join(F.broadcast(wanted), "k")
        often = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
        weighed = cut(wanted.groupBy("k").agg(F.collect_list("label").alias("_l")).join(often, "k"), "weighed")  # labels that differ in case alone
        return salted_join(rows, weighed, ["k"], "_n").withColumn("label", F.explode("_l"))

    kw = items(c, "keywords", lower=True).select(F.col("item").alias("k"), *num)
    found = cut(met_by(kw, keys).select("label", *num, F.lit("keyword").alias("matched")).distinct(), "matched")
    rest = cut(keys.join(found.select("label").distinct(), "label", "left_anti").filter("k <> ''"), "rest")
    for name in ("author", "title", "author_year"):
        if rest.isEmpty():
            break
        if name == "author":
            more = met_by(items(c.withColumn("authors", F.lower("authors")), "authors").select(F.col("item").alias("k"), *num), rest)
        elif name == "title":
            more = _containing(c.select(*num, F.lower("title").alias("t")), rest.select("label", "k"), [])
        else:
            bare = F.regexp_replace(F.regexp_replace("k", r"[0-9]+", ""), r"^[() ,]+|[() ,]+$", "")
            named = rest.select("label", bare.alias("k"), year_of("label").alias("year")).filter("k <> '' and year > 0")
            more = _containing(c.filter("year > 0").select(*num, F.lower("authors").alias("t")), named, ["year"])
        more = cut(more.select("label", *num, F.lit(name).alias("matched")).distinct(), "matched")
        rest = cut(rest.join(more.select("label").distinct(), "label", "left_anti"), "rest")
        found = found.unionByName(more)
    return found.groupBy("label", "matched").agg(
        F.count(F.lit(1)).alias("papers"),
        F.round(F.avg(F.when(F.col("year") > 0, F.col("year"))), 1).alias("year_mean"),
        F.round(F.avg("citations"), 1).alias("citations_mean"),
        F.sum("citations").alias("citations_sum"),
    )


def _containing(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """rows (with t) whose text contains the text k of a label of equal ``by``.

    A text that contains a label has its first three characters, or all of a shorter one, so they meet on those.
    """
    wanted = cut(wanted.withColumn("gram", F.substring("k", 1, 3)), "wanted")
    none = F.array().cast("array<string>")

    def grams_of(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.substr(F.col("t"), i, F.lit(n)))
        return F.when(F.length("t") >= n, each).otherwise(none)

    grams = none
    for r in wanted.select(F.length("gram").alias("n")).distinct().collect():  # 1, 2, 3 at most
        grams = F.array_union(grams, grams_of(r.n))
    met = rows.withColumn("gram", F.explode(F.array_distinct(grams)))
    keys = [*by, "gram"]
    if fits(wanted):
        met = met.join(F.broadcast(wanted), keys)
    else:
        often = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        met = salted_join(met, cut(wanted.groupBy(*keys).agg(F.collect_list(F.struct("label", "k")).alias("_w")).join(often, keys), "by_gram"), keys, "_n")
        met = met.select(*rows.columns, F.inline("_w"))
    return met.filter(F.contains("t", "k"))
