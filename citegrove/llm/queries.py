"""Queries of this subpackage over whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrove.functions.text import real_abstract
from citegrove.llm import canonical, cooccur, langid, mixing, pieces, setjoin, survivors, termcount, tokens
from citegrove.llm.sql import SQL
from citegrove.plans.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.record_pairs(table(spark, sf_dir, "records")).select("field", "item_a", "item_b")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of items, however rare and whatever its lift."""
    return cooccur.record_pairs(table(spark, sf_dir, "records"), 1, 0.0).withColumn("lift", F.round("lift", 6))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.surviving_rows(table(spark, sf_dir, "records"))


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.merged_records(table(spark, sf_dir, "records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.formatting_duplicates(table(spark, sf_dir, "records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_terms(spark, sf_dir).filter("mark is not null").select("field", "term", "mark")


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "records")
    return termcount.marked_terms(termcount.record_terms(records), records.count())


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = langid.corpus_texts(table(spark, sf_dir, "records"), table(spark, sf_dir, "documents"), real_abstract("abstract"))
    return texts, langid.languages(texts, langid.trained(texts))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, judged = _judged(spark, sf_dir)
    return langid.wrong_or_missing(judged).select("item_kind", "item_id", "seg_no", "lang")


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)[1].drop("label")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.SetJoin(setjoin.reference_sets(table(spark, sf_dir, "records"))).pairs()


def p7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.SetJoin(setjoin.reference_sets(table(spark, sf_dir, "records"))).links()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"))


def p8_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trips(table(spark, sf_dir, "documents")).select("doc_id", "same")


def p9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).usage


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).shares


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_documents(table(spark, sf_dir, "documents"), pieces.limits_of(table(spark, sf_dir, "piece_limits")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_pairs, p2_found, p2_merged, p3_found, p5_found, p5_terms, p6_found, p6_languages, p7_found, p7_links, p8_ids, p8_round_trips, p9_usage, p9_shares, p10_pieces)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
