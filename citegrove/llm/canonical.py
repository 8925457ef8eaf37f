"""Duplicates hidden by formatting: canonical form, 128-bit hash, counts combined before the shuffle, collision check.

Nulls and empty titles: the canonical title is empty; such rows are copies of each other if their DOI names agree too.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citegrove.functions.text import doi_name, text
from citegrove.plans.tables import cut, salted_join

#: What lower case does not settle: all but ASCII, the Latin-1 letters with simple cases, and general punctuation.
MAY_CHANGE = r"[^\u0000-´¶-Þà-ÿ‐-‧‰-⁞]"


def folded(x: str) -> str:
    """A text under full case folding, of equal forms for what is canonically equivalent or differs in case only.

    Upper case first, for the letters that meet only there (the dotless i and I).
    """
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", x).upper().casefold())


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else folded(x))


def letters_and_digits(c: Column | str) -> Column:
    """Letters and decimal digits in order, their case folded in full (so that the German sharp s equals SS), NFC.

    Texts that lower case folds as well stay in the JVM.
    """
    s = text(c)
    whole = F.coalesce(_folded(F.when(s.rlike(MAY_CHANGE), s)), F.lower(s))
    return F.regexp_replace(whole, r"[^\p{L}\p{Nd}]+", "")


def fingerprint(canonical: Column) -> tuple[Column, Column, Column]:
    """Two 64-bit halves of the key and an independent check value."""
    return F.xxhash64(F.lit("k1"), canonical), F.xxhash64(F.lit("k2"), canonical), F.hash(F.lit("check"), canonical, F.length(canonical))


def collapse(df: DataFrame, id_col: str, canonical: Column) -> DataFrame:
    """(first_id, copy_id) of every row that is not the first of its canonical form. Rows without id are no copies; rows of one id are one.

    Groups are counted with map-side combining on (k1, k2); only groups of two or more rows are kept. A group whose
    check values differ holds a hash collision; its rows are regrouped on the canonical text itself.
    """
    base = df.select(F.col(id_col).alias("_id"), canonical.alias("_canon"))
    k1, k2, check = fingerprint(F.col("_canon"))
    keyed = base.select("_id", "_canon", k1.alias("_k1"), k2.alias("_k2"), check.alias("_check"))
    groups = cut(
        keyed.groupBy("_k1", "_k2").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("_n"), F.min("_check").alias("_lo"), F.max("_check").alias("_hi")).filter("_n > 1"),
        "canon",
    )
    clean = groups.filter("_lo = _hi").select("_k1", "_k2", "first_id", "_n")
    found = salted_join(keyed.select("_id", "_k1", "_k2"), clean, ["_k1", "_k2"], "_n").filter("_id <> first_id").select("first_id", F.col("_id").alias("copy_id"))
    if groups.filter("_lo <> _hi").isEmpty():
        return found
    clash = salted_join(keyed.select("_id", "_canon", "_k1", "_k2"), groups.filter("_lo <> _hi").select("_k1", "_k2", "_n"), ["_k1", "_k2"], "_n")
    again = clash.groupBy("_k1", "_k2", "_canon").agg(F.min("_id").alias("first_id"))
    return found.unionByName(clash.join(again, ["_k1", "_k2", "_canon"]).filter("_id <> first_id").select("first_id", F.col("_id").alias("copy_id")))


def formatting_duplicates(records: DataFrame) -> DataFrame:
    """Rows of records with equal (or both missing) DOI names and equal letters and digits of the title."""
    canonical = F.concat(F.coalesce(doi_name("doi"), F.lit("")), F.lit("\n"), letters_and_digits("title"))
    return collapse(records.select("rec_id", "doi", "title"), "rec_id", canonical)
