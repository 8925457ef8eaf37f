"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citegrove.operators import packed_fields
from citegrove.plans import bibliometrics
from citegrove.plans.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = packed_fields.split_values(table(spark, sf_dir, "raw_records"), "raw_id", ["authors", "keywords", "refs"])
    return values.select(values.id.alias("raw_id"), "field", "pos", "item")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return bibliometrics.QUERIES | {"p4_found": p4_found}


def oracle_sql() -> dict[str, str]:
    return dict(bibliometrics.SQL)
