"""Exports of networks and corpora, as DataFrames of rows or lines and as files."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrove.functions.text import text, year_of
from citegrove.operators.corpus import items
from citegrove.operators.graph import PALETTE, both_ways, degrees, scaled
from citegrove.plans.tables import cut, numbered_rows

COLOR = "element_at(array({}), cast(pmod(cluster_id, 8) + 1 as int))".format(", ".join(f"'{c}'" for c in PALETTE))


def node_ranking(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, between: DataFrame) -> DataFrame:
    """(node, degree, weighted_degree, betweenness, cluster_id, color, occurrences, doc_freq, relevance, year_mean), strongest first.

    ``year_mean`` is null where nodes have none.
    """
    if "year_mean" not in nodes.columns:
        nodes = nodes.withColumn("year_mean", F.lit(None).cast("double"))
    d = nodes.withColumnRenamed("term", "node").join(degrees(edges), "node", "left").join(clusters, "node", "left").join(between, "node", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return d.select("node", zero("degree"), zero("weighted_degree"), F.round(zero("betweenness"), 4).alias("betweenness"), "cluster_id", F.expr(COLOR).alias("color"), "occurrences", "doc_freq", "relevance", "year_mean").orderBy(F.desc("weighted_degree"), "node")


def edge_list(edges: DataFrame) -> DataFrame:
    """(source, target, weight, weight_raw), heaviest first."""
    raw = F.col("weight_raw") if "weight_raw" in edges.columns else F.col("weight")
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight", raw.alias("weight_raw")).orderBy(F.desc("weight"), "source", "target")


def vos_map(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The map (id, label, weight, relevance, doc_freq) with ids from 1 by label, and the network (id_a, id_b, weight).

    Nodes that have them also keep cluster_id, x, y and the two scores year_mean and citations_mean.
    """
    more = [c for c in ("cluster_id", "x", "y", "year_mean", "citations_mean") if c in nodes.columns]
    placed = cut(numbered_rows(nodes, [F.asc("term")], "_no"), "ids")
    ids = placed.select((F.col("_no") + 1).alias("id"), F.col("term").alias("label"), F.col("occurrences").alias("weight"), "relevance", "doc_freq", *more)
    a, b = ids.select(F.col("label").alias("src"), F.col("id").alias("id_a")), ids.select(F.col("label").alias("dst"), F.col("id").alias("id_b"))
    return ids, edges.join(a, "src").join(b, "dst").select("id_a", "id_b", "weight")


def topology_json(nodes: DataFrame, edges: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One JSON object per node and per edge: (part, value). Sizes are scaled to 10-40; nodes have their cluster and its
    colour, -1 and the first colour where there is none."""
    n = scaled(nodes.select(F.col("term").alias("node"), F.col("occurrences").cast("double").alias("occurrences"), "doc_freq", "relevance"), "occurrences")
    n = n.join(clusters, "node", "left") if clusters is not None else n.withColumn("cluster_id", F.lit(None).cast("int"))
    n = n.withColumn("color", F.coalesce(F.expr(COLOR), F.lit(PALETTE[0]))).withColumn("cluster", F.coalesce("cluster_id", F.lit(-1)))
    value = F.struct(F.col("node").alias("id"), F.col("node").alias("label"), F.round("size", 2).alias("size"), "color", "cluster", F.col("occurrences").cast("long").alias("occurrences"), "doc_freq", F.col("relevance").cast("decimal(18,6)").alias("relevance"))
    one = n.select(F.lit("node").alias("part"), F.to_json(value).alias("value"))
    return one.unionByName(edges.select(F.lit("edge").alias("part"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")).alias("value")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other, weight) of the symmetric matrix, in long form; ``wide_adjacency`` makes columns of it."""
    return both_ways(edges).select("node", "other", "weight")


def wide_adjacency(edges: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row per node and a column per node of ``names``, by default of every node; a column for each is what is asked for."""
    if names is None:
        names = [r[0] for r in both_ways(edges).select("node").distinct().orderBy("node").collect()]  # become the columns
    wide = both_ways(edges).groupBy("node").pivot("other", names or [""]).agg(F.sum("weight")).na.fill(0)
    return wide.orderBy("node")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), '"', "&quot;"), F.lit('"'))


def gml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GML file: (place, line)."""
    ids, net = vos_map(nodes, edges)
    head = ids.sparkSession.createDataFrame([(0, "graph ["), (4, "]")], "place int, line string")
    n = ids.select(F.lit(1).alias("place"), F.concat(F.lit("  node [ id "), "id", F.lit(" label "), _quoted(F.col("label")), F.lit(" ]")).alias("line"))
    e = net.select(F.lit(2).alias("place"), F.concat(F.lit("  edge [ source "), "id_a", F.lit(" target "), "id_b", F.lit(" weight "), F.col("weight").cast("string"), F.lit(" ]")).alias("line"))
    return head.unionByName(n).unionByName(e).orderBy("place", "line")


def pajek(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a Pajek file: (place, line)."""
    ids, net = vos_map(nodes, edges)
    head = ids.agg(F.concat(F.lit("*vertices "), F.count(F.lit(1))).alias("line")).select(F.lit(0).alias("place"), F.lit(0).alias("k"), "line")
    n = ids.select(F.lit(1).alias("place"), F.col("id").alias("k"), F.concat("id", F.lit(" "), _quoted(F.col("label"))).alias("line"))
    star = ids.sparkSession.createDataFrame([(2, 0, "*edges")], "place int, k int, line string")
    e = net.select(F.lit(3).alias("place"), F.col("id_a").alias("k"), F.concat_ws(" ", "id_a", "id_b", F.col("weight").cast("string")).alias("line"))
    return head.unionByName(n).unionByName(star).unionByName(e).orderBy("place", "k", "line").select("place", "line")


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GEXF file: (place, line)."""
    ids, net = vos_map(nodes, edges)
    frame = [(0, '<gexf version="1.2"><graph defaultedgetype="undirected"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")]
    n = ids.select(F.lit(1).alias("place"), F.concat(F.lit('<node id="'), "id", F.lit('" label='), _quoted(F.regexp_replace(F.regexp_replace("label", "&", "&amp;"), "<", "&lt;")), F.lit("/>")).alias("line"))
    e = net.select(F.lit(3).alias("place"), F.concat(F.lit('<edge source="'), "id_a", F.lit('" target="'), "id_b", F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("line"))
    return ids.sparkSession.createDataFrame(frame, "place int, line string").unionByName(n).unionByName(e).orderBy("place", "line")


def sigma_json(nodes: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """One JSON object per node and per edge: (part, value); sizes scaled to 3-18, missing or infinite places are 0."""
    safe = lambda c: F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)).alias(c)
    n = scaled(nodes.select(F.col("term").alias("node"), F.col("occurrences").cast("double").alias("occurrences")), "occurrences", 3, 18).join(positions, "node", "left")
    one = n.select(F.lit("node").alias("part"), F.to_json(F.struct(F.col("node").alias("key"), F.struct(F.col("node").alias("label"), "size", safe("x"), safe("y")).alias("attributes"))).alias("value"))
    return one.unionByName(edges.select(F.lit("edge").alias("part"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.struct("weight").alias("attributes"))).alias("value")))


def report_lines(report: DataFrame) -> DataFrame:
    """Text lines of a cluster report, one per cluster."""
    return report.select("cluster_id", F.concat(F.lit("Cluster "), "cluster_id", F.lit(" (n="), "size", F.lit("): "), "top_nodes").alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_sheets(at: str, rankings: DataFrame, edges: DataFrame, raw: DataFrame | None = None) -> None:
    """The three sheets of a workbook (rankings, edges, and the records if given) as a folder of CSV each."""
    for name, df in {"rankings": rankings, "edges": edges, "records": raw}.items():
        if df is not None:
            write_csv(df, f"{at}/{name}")


def save_project(at: str, manifest: dict, **tables: DataFrame) -> None:
    """A project: a folder of tables and a manifest with their names and the format's version."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    spark = next(iter(tables.values())).sparkSession
    body = json.dumps(manifest | {"version": 1, "tables": sorted(tables)}, ensure_ascii=False)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")


def load_project(spark: SparkSession, at: str) -> tuple[dict, dict[str, DataFrame]]:
    manifest = json.loads(spark.read.text(f"{at}/manifest").first()[0])
    if manifest.get("version", 0) > 1:
        raise ValueError("the project is of a later version")
    return manifest, {t: spark.read.parquet(f"{at}/{t}") for t in manifest["tables"]}


def append_backlog(events: DataFrame, path: str) -> None:
    """Adds (ts, action, detail) events as JSON lines."""
    events.select("ts", "action", "detail").write.mode("append").json(path)


def seminal(c: DataFrame, k: int = 20) -> DataFrame:
    """(item, n, doi, year, author) of the k most cited references, as parsed from their text."""
    top = items(c.withColumn("refs", F.regexp_replace("refs", "\n", ";")), "refs", "semicolon").groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(k)
    return top.select("item", "n", F.regexp_extract("item", r"(10\.\d{4,9}/[^\s,;]+)", 1).alias("doi"), year_of("item").alias("year"), F.regexp_extract("item", r"^([^\s,;(]+)", 1).alias("author"))


def open_pdfs(c: DataFrame) -> DataFrame:
    """(rec_id, oa_url, file) of the records with an open copy; the file name is a slug of year and title."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text("title")), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return c.filter("is_oa and oa_url <> ''").select("rec_id", "oa_url", F.concat(F.col("year").cast("string"), F.lit("_"), F.substring(slug, 1, 60), F.lit(".pdf")).alias("file"))


def slugify(name: str) -> str:
    """ASCII letters and digits in lower case, joined by hyphens."""
    bare = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return "-".join("".join(ch if ch.isalnum() else " " for ch in bare).split())
