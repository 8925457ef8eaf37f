"""Best representative of each duplicate group, field by field, by deterministic window ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrove.functions.text import doi_name, real_abstract
from citegrove.operators.dedup import origin_rank


def best_rows(df: DataFrame, key: str, id_col: str, latest: Column, scores: dict[str, Column], none: int | None = 0) -> DataFrame:
    """For each key of two or more rows: the id of the best row for each role, ``none`` where no row qualifies.

    ``scores`` gives for each role the score of a row, higher being better, null where the row cannot serve. Ties go
    to the latest row (null being the earliest), then to the smaller id. Rows with a null key or id take no part.

    Each row becomes one candidate per role it can serve, and one ranking serves all roles. The filter on the rank
    lets Spark keep only the first row per (key, role) in each map task before the shuffle, so that a group holding a
    third of the table reaches its reducer as one row per map task and role.
    """
    roles = F.filter(F.array(*(F.struct(F.lit(i).alias("role"), s.cast("long").alias("score")) for i, s in enumerate(scores.values()))), lambda x: x["score"].isNotNull())
    base = df.filter(F.col(key).isNotNull() & F.col(id_col).isNotNull()).select(key, F.col(id_col).alias("_id"), latest.alias("_at"), roles.alias("_roles"))
    one = base.select(key, "_id", "_at", F.inline("_roles"))
    order = [F.desc("score"), F.desc_nulls_last("_at"), F.asc("_id")]
    top = one.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "role").orderBy(*order))).filter("_rank = 1")
    picked = top.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("role") == i, F.col("_id"))), F.lit(none)).cast("long").alias(name) for i, name in enumerate(scores)))
    many = base.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    return picked.join(many, key)


def _best_of_works(records: DataFrame, none: int | None = 0) -> DataFrame:
    base = records.select("rec_id", "harvested_at", "citations", doi_name("doi").alias("doi_name"), origin_rank("origin").alias("trust"), F.length(real_abstract("abstract")).alias("abstract_len"))
    scores = {"keep_id": -F.col("trust"), "abstract_id": F.col("abstract_len"), "citations_id": F.when(F.col("citations") > 0, F.lit(1))}
    return best_rows(base, "doi_name", "rec_id", F.col("harvested_at"), scores, none).select("doi_name", *scores)


def surviving_rows(records: DataFrame) -> DataFrame:
    """doi_name, keep_id, abstract_id, citations_id of every DOI name that two or more rows have."""
    return _best_of_works(records)


def merged_records(records: DataFrame) -> DataFrame:
    """One built record per DOI name of two or more rows: the kept row with the best abstract and citation count.

    Column ``citations`` is 0 and ``abstract`` '' where no row of the group has one. The rows chosen for any role are
    fetched in one join on their ids, of which there are at most three a group, and put together by group.
    """
    best = _best_of_works(records, None)
    roles = F.array(*(F.struct(F.col(f"{r}_id").alias("rec_id"), F.lit(r).alias("role")) for r in ("keep", "abstract", "citations")))
    wanted = best.select("doi_name", F.inline(roles)).filter("rec_id is not null")
    rows = records.select("rec_id", "title", "year", "source", "origin", "citations", "abstract")
    got = wanted.join(rows, "rec_id")
    of = lambda role, value: F.max(F.when(F.col("role") == role, value))
    kept = [of("keep", F.col(c)).alias(c) for c in ("title", "year", "source", "origin")]
    out = got.groupBy("doi_name").agg(of("keep", F.col("rec_id")).alias("keep_id"), *kept, of("abstract", real_abstract("abstract")).alias("abstract"), of("citations", F.col("citations")).alias("citations"))
    return out.select("doi_name", "keep_id", "title", "year", "source", "origin", F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce("citations", F.lit(0)).cast("long").alias("citations"))
