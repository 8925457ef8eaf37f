"""The canonical corpus record and its item tables.

Strings are never null ('' is missing), year 0 is unknown, citations are never null. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.functions.text import let, split_auto, split_semicolon, text

STRINGS = ("authors", "title", "source", "keywords", "abstract", "doi", "refs", "origin", "language", "language_source", "oa_url", "ipc")
#: Letters of a term token (a fixed value); other letters break a word.
TOKEN = r"[a-záéíóúàâêôãõüç\-]+"


def corpus(records: DataFrame) -> DataFrame:
    """Records with strings coalesced to '', year and citations to 0, is_oa to false; missing columns are filled so."""
    have = set(records.columns)
    strings = [text(c).alias(c) if c in have else F.lit("").alias(c) for c in STRINGS]
    number = lambda c, kind: (F.coalesce(F.col(c).cast(kind), F.lit(0)) if c in have else F.lit(0)).cast(kind).alias(c)
    oa = F.coalesce(F.col("is_oa"), F.lit(False)) if "is_oa" in have else F.lit(False)
    return records.select("rec_id", *strings, number("year", "int"), number("citations", "long"), oa.alias("is_oa"))


def items(c: DataFrame, field: str, sep: str = "auto", lower: bool = False, keep: tuple[str, ...] = ("rec_id", "year", "citations")) -> DataFrame:
    """(keep..., pos, item): one row per listed value, repeats kept. sep: auto (; else ,), semicolon, or whole (not split)."""
    value = F.lower(F.col(field)) if lower else F.col(field)
    values = {"auto": split_auto, "semicolon": split_semicolon, "whole": lambda x: F.array(x)}[sep](value)
    return c.select(*keep, F.posexplode(values).alias("pos", "item"))


def stop_words(extra: tuple[str, ...] = (), languages: tuple[str, ...] = ("english", "portuguese")) -> list[str]:
    """Stop words of Spark's own lists plus extras; pass another list to the callers to replace them."""
    return sorted({w.lower() for name in languages for w in StopWordsRemover.loadDefaultStopWords(name)} | {w.lower() for w in extra})


def tokens(c: Column, stops: list[str]) -> Column:
    """Lower-case tokens of over two letters that are no stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1), lambda x: (F.length(x) > 2) & ~x.isin(stops))


def ngrams(words: Column, most: int = 3) -> Column:
    """All n-grams of 1 to ``most`` words; formed after stop words are gone, so they may span removed words."""

    def grams(w: Column) -> Column:
        def of(n: int) -> Column:
            each = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
            return F.when(F.size(w) >= n, each).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.array(w, *map(of, range(2, most + 1))))

    return let(words, grams)


def doc_terms(c: DataFrame, field: str = "keywords", stops: list[str] | None = None, most: int = 3) -> DataFrame:
    """(rec_id, year, citations, pos, term) by field: keywords, titles, abstracts or titles_abstracts. Empty documents give no rows."""
    if field == "keywords":
        return items(c, "keywords", lower=True).withColumnRenamed("item", "term")
    source = {"titles": F.col("title"), "abstracts": F.col("abstract"), "titles_abstracts": F.concat_ws(" ", "title", "abstract")}[field]
    words = c.select("rec_id", "year", "citations", tokens(source, stop_words() if stops is None else stops).alias("words"))
    return words.select("rec_id", "year", "citations", F.posexplode(ngrams(F.col("words"), most)).alias("pos", "term"))


def with_thesaurus(terms: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """Terms replaced by their canonical form; of repeated thesaurus terms the last row wins, rows with an empty side are dropped.

    The thesaurus is a small table by its nature; Spark chooses the join by its size.
    """
    t = thesaurus.select(F.lower(F.trim("term")).alias("term"), F.lower(F.trim("canonical")).alias("canonical"), "row_no").filter("term <> '' and canonical <> ''")
    last = t.groupBy("term").agg(F.max_by("canonical", "row_no").alias("canonical"))
    return terms.join(last, "term", "left").withColumn("term", F.coalesce("canonical", "term")).drop("canonical")


def counts(terms: DataFrame, value: str = "term") -> DataFrame:
    """(value, occurrences with repeats, documents)."""
    per_doc = terms.groupBy(value, "rec_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_doc.groupBy(value).agg(F.sum("_n").alias("occurrences"), F.count(F.lit(1)).alias("doc_freq"))


def relevance(counted: DataFrame, terms: DataFrame) -> DataFrame:
    """counts with relevance = occurrences * ln((N + 1) / (doc_freq + 1)), N being the documents that have any term."""
    n = terms.agg(F.countDistinct("rec_id").alias("_docs"))  # one row
    r = F.col("occurrences") * F.log((F.col("_docs") + 1) / (F.col("doc_freq") + 1))
    return counted.crossJoin(F.broadcast(n)).withColumn("relevance", F.round(r, 6)).drop("_docs")
