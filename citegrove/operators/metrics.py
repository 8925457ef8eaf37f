"""Productivity, dispersion, growth and trend statistics of a corpus. Ties are ordered by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrove.operators.corpus import counts, items
from citegrove.plans.tables import running_total


def top_items(c: DataFrame, field: str, sep: str = "auto", lower: bool = False, k: int = 20) -> DataFrame:
    """(item, n) of the k most frequent values of a field; a report."""
    return items(c, field, sep, lower).groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(k)


def threshold_preview(terms: DataFrame, least: int) -> DataFrame:
    """One row: distinct terms, and those with at least ``least`` occurrences."""
    return counts(terms).agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("occurrences") >= least).alias("passing"))


def author_indices(c: DataFrame) -> DataFrame:
    """(author, papers, h, g, citations_mean) of every author.

    h: papers with at least as many citations as their place; g: the last place up to which citations sum to its square.
    Papers are first counted by author and number of citations, so an author of a large part of all papers is no
    larger in the window than the different citation numbers there are. Within one such level the places that satisfy
    g's condition follow from a quadratic.
    """
    each = items(c, "authors", keep=("rec_id", "citations"))
    level = each.groupBy(F.col("item").alias("author"), F.col("citations").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("author").orderBy(F.desc("c"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("s0", F.coalesce(F.sum(F.col("n") * F.col("c")).over(before), F.lit(0)))
    n1 = F.col("n0") + F.col("n")
    root = F.col("c") * F.col("c") + 4.0 * (F.col("s0") - F.col("c") * F.col("n0"))
    reach = F.least(n1, F.floor((F.col("c") + F.sqrt(root)) / 2 + 1e-9))
    g = F.when((root >= 0) & (reach > F.col("n0")), reach)
    return level.groupBy("author").agg(
        F.sum("n").alias("papers"),
        F.greatest(F.max(F.least(n1, F.col("c"))), F.lit(0)).cast("long").alias("h"),
        F.coalesce(F.max(g), F.lit(0)).cast("long").alias("g"),
        F.round(F.sum(F.col("n") * F.col("c")) / F.sum("n"), 4).alias("citations_mean"),
    )


def summary(c: DataFrame) -> DataFrame:
    """One row: papers, first and last year (0 included), greatest and mean citations."""
    return c.agg(F.count(F.lit(1)).alias("papers"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.max("citations").alias("citations_max"), F.round(F.avg("citations"), 2).alias("citations_mean"))


def network_summary(c: DataFrame, nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """summary's row with the nodes, edges, clusters and density (0 under two nodes) of a network of the corpus."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    k = clusters.agg(F.coalesce(F.max("cluster_id") + 1, F.lit(0)).cast("long").alias("clusters"))
    d = F.when(F.col("nodes") > 1, F.round(2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 4)).otherwise(0.0)
    return summary(c).crossJoin(n).crossJoin(m).crossJoin(k).withColumn("density", d)  # one row each


def descriptive(c: DataFrame) -> DataFrame:
    """One row: papers, first, last and median year of known years, sum, mean and greatest citations."""
    known = F.when(F.col("year") > 0, F.col("year"))
    return c.agg(
        F.count(F.lit(1)).alias("papers"), F.min(known).alias("year_min"), F.max(known).alias("year_max"), F.floor(F.median(known)).cast("int").alias("year_median"),
        F.sum("citations").alias("citations_sum"), F.round(F.avg("citations"), 2).alias("citations_mean"), F.max("citations").alias("citations_max"),
    )


def yearly(c: DataFrame) -> DataFrame:
    """(year, n) of known years."""
    return c.filter("year > 0").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def growth(c: DataFrame) -> DataFrame:
    """One row: first and last year, their papers, and the compound annual growth rate (null for a single year)."""
    ends = yearly(c).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("n", "year").alias("first_n"), F.max_by("n", "year").alias("last_n"))
    span = F.col("last_year") - F.col("first_year")
    return ends.withColumn("cagr", F.when(span > 0, F.round(F.pow(F.col("last_n") / F.col("first_n"), 1.0 / span) - 1, 6)))


def bradford(c: DataFrame) -> DataFrame:
    """(zone, sources, articles): zones of sources, most productive first, that each close at a third of all articles.

    A zone closes at the first source by which articles reach its third; at most one zone closes at a source, and a
    third zone that the end is reached without is not given. ``articles`` is the count up to the zone's end.
    """
    by_source = c.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    r = running_total(by_source, [F.desc("n"), F.asc("source")], "n")
    whole = r.agg(F.sum("n").alias("total"))
    r = r.crossJoin(F.broadcast(whole))  # one row
    e1 = r.filter(F.col("upto") >= F.col("total") / 3.0).agg(F.min("rank").alias("e1"))
    e2 = r.crossJoin(F.broadcast(e1)).filter((F.col("upto") >= 2 * F.col("total") / 3.0) & (F.col("rank") > F.col("e1"))).groupBy("e1").agg(F.min("rank").alias("e2"))
    zone = F.when(F.col("rank") <= F.col("e1"), 1).when(F.col("rank") <= F.col("e2"), 2).otherwise(3)
    return r.crossJoin(F.broadcast(e2)).withColumn("zone", zone).groupBy("zone").agg(F.count(F.lit(1)).alias("sources"), F.max("upto").cast("long").alias("articles"))


def single_paper_share(c: DataFrame) -> DataFrame:
    """One row: authors, those of a single paper, and their share (null without authors)."""
    n = items(c, "authors").groupBy("item").agg(F.count(F.lit(1)).alias("papers"))
    one = n.agg(F.count(F.lit(1)).alias("authors"), F.count_if(F.col("papers") == 1).alias("single"))
    return one.withColumn("share", F.when(F.col("authors") > 0, F.round(F.col("single") / F.col("authors"), 6)))


def lotka(c: DataFrame, most: int = 8) -> DataFrame:
    """(papers, authors, expected) of the first ``most`` numbers of papers; expected is round(n1 / k^2)."""
    each = items(c, "authors").groupBy("item").agg(F.count(F.lit(1)).alias("papers")).groupBy("papers").agg(F.count(F.lit(1)).alias("authors"))
    n1 = each.agg(F.coalesce(F.max(F.when(F.col("papers") == 1, F.col("authors"))), F.lit(0)).alias("n1"))
    first = each.orderBy("papers").limit(most).crossJoin(F.broadcast(n1))  # one row
    return first.select("papers", "authors", F.bround(F.col("n1") / (F.col("papers") * F.col("papers"))).cast("long").alias("expected"))


def last_year(c: DataFrame) -> DataFrame:
    return c.agg(F.max("year").alias("_last"))


def rising(terms: DataFrame, c: DataFrame, k: int = 15, last: int | None = None) -> DataFrame:
    """(term, recent, early, ratio): the k terms that grew most; recent is the last three years, early the five before.

    ``last`` is the last year, by default that of the corpus; terms of later years then take no part, as an absurd year
    in one record would leave no recent ones.
    """
    t = terms.filter("year > 0")
    t = t.crossJoin(F.broadcast(last_year(c))) if last is None else t.filter(F.col("year") <= last).withColumn("_last", F.lit(last))  # one row
    recent, early = F.col("year") >= F.col("_last") - 2, (F.col("year") >= F.col("_last") - 7) & (F.col("year") <= F.col("_last") - 3)
    n = t.groupBy("term").agg(F.count_if(recent).alias("recent"), F.count_if(early).alias("early")).filter("recent >= 2")
    return n.withColumn("ratio", F.round(F.col("recent") / (F.col("early") + 0.5), 6)).orderBy(F.desc("ratio"), "term").limit(k)


def _calendar(c: DataFrame) -> DataFrame:
    """(year, pubs) of every year from the first to the last known one."""
    n = yearly(c)
    span = n.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return span.join(F.broadcast(n), "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("pubs"))  # a row per year


def bursts(terms: DataFrame, c: DataFrame, z: float = 1.645, least: int = 4) -> DataFrame:
    """(term, start, end, strength): runs of years in which a term's share of papers is over ``z`` deviations from its mean.

    Shares are per thousand papers over every year of the corpus (a year without papers divides by 1); the deviation is
    that of the population; terms of fewer than ``least`` occurrences, or without deviation, have no bursts. Years
    without the term add nothing to the sums that mean and deviation follow from and are never bursts, so only the years
    that a term occurs in are looked at.
    """
    known = terms.filter("year > 0").groupBy("term", "year").agg(F.count(F.lit(1)).alias("n"))
    pubs = yearly(c)
    span = pubs.agg((F.max("year") - F.min("year") + 1).alias("years"))  # one row
    f = F.col("n") * 1000.0 / F.col("pubs")
    per_year = known.join(F.broadcast(pubs.withColumnRenamed("n", "pubs")), "year").select("term", "year", "n", f.alias("f"))  # a row per year
    w = Window.partitionBy("term")
    d = per_year.withColumn("occurrences", F.sum("n").over(w)).withColumn("s", F.sum("f").over(w)).withColumn("s2", F.sum(F.col("f") * F.col("f")).over(w)).filter(F.col("occurrences") >= least)
    mean = F.col("s") / F.col("years")
    d = d.crossJoin(F.broadcast(span)).withColumn("mean", mean).withColumn("var", F.col("s2") / F.col("years") - mean * mean)
    hot = d.filter(F.col("var") > 1e-9 * F.col("mean") * F.col("mean")).withColumn("score", (F.col("f") - F.col("mean")) / F.sqrt("var")).filter(F.col("score") > z)
    hot = hot.withColumn("island", F.col("year") - F.row_number().over(w.orderBy("year")))
    return hot.groupBy("term", "island").agg(F.min("year").alias("start"), F.max("year").alias("end"), F.round(F.sum("score"), 4).alias("strength")).drop("island")


def trends(terms: DataFrame, c: DataFrame, k: int = 14) -> DataFrame:
    """(term, year, n): documents per year, zero-filled, of the k most frequent terms."""
    best = counts(terms).orderBy(F.desc("occurrences"), "term").limit(k).select("term")
    n = terms.join(F.broadcast(best), "term", "left_semi").groupBy("term", "year").agg(F.countDistinct("rec_id").alias("n"))
    return best.crossJoin(_calendar(c).select("year")).join(n, ["term", "year"], "left").select("term", "year", F.coalesce("n", F.lit(0)).alias("n"))


def periods(c: DataFrame, years: int = 5) -> DataFrame:
    """c with ``period``: the first year of its window of ``years`` years from the first known year; unknown years leave."""
    first = c.filter("year > 0").agg(F.min("year").alias("_first"))
    at = F.col("_first") + F.floor((F.col("year") - F.col("_first")) / years) * years
    return c.filter("year > 0").crossJoin(F.broadcast(first)).withColumn("period", at.cast("int")).drop("_first")  # one row


def evolution(c: DataFrame, years: int = 5, least_papers: int = 3, min_occurrence: int = 3) -> DataFrame:
    """(period, papers, nodes, edges, density, top_terms) of the keyword network of each window; smaller windows are skipped."""
    papers, n, edges = period_networks(c, years, least_papers, min_occurrence)
    m = edges.groupBy("period").agg(F.count(F.lit(1)).alias("edges"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("n"), "node"))
    top = n.withColumn("r", rank).filter("r <= 5").groupBy("period").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]), "; ").alias("top_terms"))
    nodes = n.groupBy("period").agg(F.count(F.lit(1)).alias("nodes"))
    out = papers.join(nodes, "period", "left").join(m, "period", "left").join(top, "period", "left")
    v, e = F.coalesce("nodes", F.lit(0)), F.coalesce("edges", F.lit(0))
    return out.select("period", "papers", v.alias("nodes"), e.alias("edges"), F.when(v > 1, F.round(2.0 * e / (v * (v - 1)), 6)).otherwise(0.0).alias("density"), F.coalesce("top_terms", F.lit("")).alias("top_terms"))


def period_networks(c: DataFrame, years: int = 5, least_papers: int = 3, min_occurrence: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(period, papers), (period, node, n) and (period, src, dst, weight) of the keyword network of each window of enough papers."""
    p = periods(c, years)
    papers = p.groupBy("period").agg(F.count(F.lit(1)).alias("papers")).filter(F.col("papers") >= least_papers)
    t = items(p, "keywords", lower=True, keep=("period", "rec_id")).join(F.broadcast(papers.select("period")), "period", "left_semi")  # a row per window
    n = t.groupBy("period", "item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_occurrence)
    docs = t.join(n, ["period", "item"], "left_semi").groupBy("period", "rec_id").agg(F.array_sort(F.collect_set("item")).alias("v"))
    m = F.size("v")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), m - 1), lambda i: F.transform(F.slice("v", i + 1, m - i), lambda y: F.struct(F.element_at("v", i).alias("src"), y.alias("dst")))))
    edges = docs.filter(m > 1).select("period", F.inline(pairs)).groupBy("period", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return papers, n.withColumnRenamed("item", "node"), edges


def author_keyword_pairs(c: DataFrame, per_record: int = 5, k: int = 15) -> DataFrame:
    """(author, keyword, n) of the k most frequent pairs among the first ``per_record`` of each field of a record."""
    a = items(c, "authors", keep=("rec_id",)).filter(F.col("pos") < per_record).select("rec_id", F.col("item").alias("author"))
    w = items(c, "keywords", lower=True, keep=("rec_id",)).filter(F.col("pos") < per_record).select("rec_id", F.col("item").alias("keyword"))
    return a.join(w, "rec_id").groupBy("author", "keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author", "keyword").limit(k)


def sankey(c: DataFrame, fields: tuple[str, str, str] = ("source", "authors", "keywords"), top: int = 10, by: str = "rows") -> DataFrame:
    """(side, src, dst, weight): flows left-middle and middle-right between the ``top`` values of each field.

    by rows: values are ranked by their occurrences, lists split on ; or ,. by relations: lists split on ;, and values are
    ranked within each side's relations; the middle is then the union of its two rankings.
    """
    sep = "auto" if by == "rows" else "semicolon"
    left, middle, right = (items(c, f, "whole" if f == "source" else sep, f == "keywords", keep=("rec_id",)).filter("item <> ''").select("rec_id", "item") for f in fields)

    def best(df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(top).select(column)

    def flow(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.withColumnRenamed("item", "src").join(b.withColumnRenamed("item", "dst"), "rec_id")

    one, two = flow(left, middle), flow(middle, right)
    if by == "rows":
        tops = [F.broadcast(best(x, "item")) for x in (left, middle, right)]
        one = flow(left.join(tops[0], "item"), middle.join(tops[1], "item"))
        two = flow(middle.join(tops[1], "item"), right.join(tops[2], "item"))
    else:
        centre = best(one, "dst").withColumnRenamed("dst", "item").unionByName(best(two, "src").withColumnRenamed("src", "item")).distinct()
        one = one.join(F.broadcast(best(one, "src")), "src").join(F.broadcast(centre.withColumnRenamed("item", "dst")), "dst")
        two = two.join(F.broadcast(centre.withColumnRenamed("item", "src")), "src").join(F.broadcast(best(two, "dst")), "dst")
    count = lambda df, side: df.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).select(F.lit(side).alias("side"), "src", "dst", "weight")
    return count(one, "left").unionByName(count(two, "right"))


def word_cloud(terms: DataFrame, k: int = 200) -> DataFrame:
    """(term, n) of the k most frequent terms of over two letters."""
    return terms.filter(F.length("term") > 2).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k)


def top_cited(c: DataFrame, k: int = 15) -> DataFrame:
    return c.select("rec_id", "title", "year", "citations").orderBy(F.desc("citations"), "rec_id").limit(k)


def overview(c: DataFrame) -> DataFrame:
    """One row: documents, sum of citations, the three most frequent authors and sources."""
    head = lambda f, sep: top_items(c.filter(F.col(f) != ""), f, sep, k=3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "item"))), lambda x: x["item"]), "; ").alias(f"top_{f}"))
    one = c.agg(F.count(F.lit(1)).alias("documents"), F.sum("citations").alias("citations"))
    return one.crossJoin(head("authors", "semicolon")).crossJoin(head("source", "whole"))  # one row each


def facet_counts(c: DataFrame, columns: tuple[str, ...] = ("language", "year", "source"), k: int = 3) -> DataFrame:
    """(facet, value, n): the k most frequent values of each column."""
    each = F.array(*(F.struct(F.lit(x).alias("facet"), F.col(x).cast("string").alias("value")) for x in columns))
    n = c.select(F.inline(each)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).filter(F.col("r") <= k).drop("r")


def facet_filter(c: DataFrame, since: int | None = None, until: int | None = None, open_access: bool = False, language: str | None = None, without_sources: list[str] | None = None, kind: str | None = None, checked_sources: list[str] | None = None) -> DataFrame:
    """Records by year range (inclusive), open access, language, type (column ``kind``), and not from the given sources.

    With ``checked_sources``, those of the ten most frequent sources that are not among them are left out; sources
    beyond the ten pass, as a list of ten boxes leaves them alone.
    """
    if checked_sources is not None:
        top = top_items(c.filter("source <> ''"), "source", "whole", k=10).filter(~F.col("item").isin(checked_sources)).select(F.col("item").alias("source"))
        c = c.join(F.broadcast(top), "source", "left_anti")  # ten rows at most
    if since is not None:
        c = c.filter(F.col("year") >= since)
    if until is not None:
        c = c.filter(F.col("year") <= until)
    if open_access:
        c = c.filter("is_oa")
    if language is not None:
        c = c.filter(F.col("language") == language)
    if kind is not None:
        c = c.filter(F.lower("kind") == kind.lower())
    return c.filter(~F.col("source").isin(without_sources)) if without_sources else c


def with_titles(c: DataFrame) -> DataFrame:
    """Records without those that have no title (null, empty or blank)."""
    return c.filter(F.trim(F.coalesce("title", F.lit(""))) != "")


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """The rows of one page, numbered from 1, of df in an order; a report."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def sorted_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """df in the order of a column as tables show it: numbers by value and before texts, a dash as -1, texts without regard to case."""
    shown = F.col(column).cast("string")
    value = F.when(shown == "—", F.lit(-1.0)).otherwise(shown.try_cast("double"))
    keys = [value.isNull(), value, F.lower(shown)]
    return df.orderBy(*(k.desc() if descending else k.asc() for k in keys))


def precision_at(c: DataFrame, groups: list[list[str]], k: int = 10) -> DataFrame:
    """One row: of the k most cited records, the share whose title or abstract has a synonym of every group."""
    head = c.orderBy(F.desc("citations"), "rec_id").limit(k)
    t = F.lower(F.concat_ws(" ", "title", "abstract"))
    good = F.lit(True)
    for group in groups:
        good &= F.coalesce(*[F.when(t.contains(w.lower()), F.lit(True)) for w in group], F.lit(False))
    return head.agg(F.count(F.lit(1)).alias("judged"), F.round(F.avg(good.cast("double")), 6).alias("precision"))


def node_papers(c: DataFrame, terms: DataFrame, k: int = 10) -> DataFrame:
    """(term, place, rec_id, citations): for each term the k most cited records that have it."""
    each = items(c, "keywords", lower=True).select(F.col("item").alias("term"), "rec_id", "citations").distinct().join(terms.select("term"), "term", "left_semi")
    by = Window.partitionBy("term").orderBy(F.desc("citations"), "rec_id")
    return each.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k).select("term", "place", "rec_id", "citations")


def project_cards(backlog: DataFrame) -> DataFrame:
    """(project, events, searches, last_event) of a backlog; actions are compared without case and blanks."""
    action = F.lower(F.trim(F.coalesce("action", F.lit(""))))
    return backlog.groupBy("project").agg(F.count(F.lit(1)).alias("events"), F.count_if(action == "search").alias("searches"), F.max("ts").alias("last_event"))
