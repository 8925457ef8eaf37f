"""Searching a corpus: field queries, TF-IDF retrieval, topics."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrove.functions.language import detected
from citegrove.operators.corpus import stop_words
from citegrove.plans.tables import cut, salted_join
from citegrove.sources.connectors import Query


def matches(c: DataFrame, q: Query) -> DataFrame:
    """Records that hold every part of a query, without regard to case; filters by year, language and open access."""
    has = lambda col, words: F.contains(F.lower(col), F.lit(words.lower()))
    anywhere = F.concat_ws(" ", "title", "abstract", "keywords")
    test = F.lit(True)
    for words in [*q.anywhere, *([q.text] if q.text else [])]:
        test &= has(anywhere, words)
    for words in q.title:
        test &= has(F.col("title"), words)
    for words in q.author:
        test &= has(F.col("authors"), words)
    if q.since is not None:
        test &= F.col("year") >= q.since
    if q.until is not None:
        test &= F.col("year") <= q.until
    if q.language:
        # records without a label are judged by what they say
        told = F.when(F.trim("language") != "", F.lower(F.substring(F.trim("language"), 1, 2))).otherwise(detected(F.concat_ws(" ", "title", "abstract"))["language"])
        test &= told == q.language
    return c.filter(test & F.col("is_oa") if q.open_access else test)


def words(c: Column, stops: list[str]) -> Column:
    """Lower-case words of two or more letters, digits or underscores, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), 1), lambda x: ~x.isin(stops))


def tfidf_search(c: DataFrame, query: str, k: int = 5, least: float = 0.01, stops: list[str] | None = None) -> DataFrame:
    """(rec_id, similarity) of the k abstracts nearest to a query: cosine of smoothed TF-IDF, idf = ln((1+n)/(1+df)) + 1.

    Only words of the query are joined; a record's norm needs the idf of all its words, so the word counts are shuffled
    once by word, those of frequent words over slices, and once by record.
    """
    stops = stop_words(languages=("english",)) if stops is None else stops
    docs = c.filter("abstract <> ''").select("rec_id", F.explode(words(F.col("abstract"), stops)).alias("w"))
    tf = docs.groupBy("rec_id", "w").agg(F.count(F.lit(1)).alias("tf"))
    n = c.filter("abstract <> ''").agg(F.count(F.lit(1)).alias("n"))  # one row
    tf = cut(tf, "words")
    idf = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("w", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = cut(idf, "idf")
    asked = c.sparkSession.range(1).select(F.explode(words(F.lit(query), stops)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("q"))
    asked = asked.join(idf, "w").select("w", (F.col("q") * F.col("idf")).alias("qw"))
    norm = asked.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    weighted = salted_join(tf, idf, ["w"], "df").select("rec_id", "w", (F.col("tf") * F.col("idf")).alias("x")).join(F.broadcast(asked), "w", "left")
    score = weighted.groupBy("rec_id").agg(F.sum(F.col("x") * F.col("qw")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("dn"))
    near = score.crossJoin(F.broadcast(norm)).select("rec_id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("similarity"))
    return near.filter(F.col("similarity") > least).orderBy(F.desc("similarity"), "rec_id").limit(k)


def topics(c: DataFrame, k: int = 5, top: int = 5, seed: int = 42, rounds: int = 10, vocabulary: int = 1 << 20) -> DataFrame:
    """(topic, terms) by LDA over abstracts; words in at least two and at most 90 % of them. No rows if no words are left.

    ``vocabulary`` bounds the words a model holds, which are topics times words numbers; the default leaves out none that
    a corpus of natural texts has.
    """
    spark = c.sparkSession
    docs = c.filter("abstract <> ''").select("rec_id", words(F.col("abstract"), stop_words(languages=("english",))).alias("words"))
    if docs.filter(F.size("words") > 0).isEmpty():
        return spark.createDataFrame([], "topic int, terms string")
    try:
        model = CountVectorizer(inputCol="words", outputCol="features", minDF=2.0, maxDF=0.9, vocabSize=vocabulary).fit(docs)
    except Exception as e:  # Spark has no type of its own for an empty vocabulary
        if "vocabulary" in str(e).lower():
            return spark.createDataFrame([], "topic int, terms string")
        raise
    found = LDA(k=k, seed=seed, maxIter=rounds).fit(model.transform(docs)).describeTopics(top).select("topic", "termIndices").collect()  # k rows
    return spark.createDataFrame([(r.topic, ", ".join(model.vocabulary[i] for i in r.termIndices)) for r in found], "topic int, terms string")
