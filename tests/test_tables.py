import os
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from citegrove.plans import tables


def sizes(df):
    """Rows per task of a plan, largest first."""
    return sorted(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect(), reverse=True)


@pytest.fixture
def static(spark):
    """Partitions as planned, in some number."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("false", "40", "-1"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_salted_join_deals_a_hot_key_by_its_weight(static):
    spark = static
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.lit("same").alias("v"))  # a third of equal rows
    lookup = tables.cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.col("k") * 2))
    out = tables.salted_join(rows, lookup, ["k"], "n", hot_rows=100)
    assert out.count() == 30_000 and out.filter("x <> 2 * k").count() == 0
    got = sizes(out)
    assert got[0] < 2 * got[len(got) // 2]
    left = tables.salted_join(rows.unionByName(spark.createDataFrame([(None, "n"), (-7, "n")], "k long, v string")), lookup, ["k"], "n", hot_rows=100, how="left")
    assert left.count() == 30_002 and left.filter("x is null").count() == 2


def test_meetings_of_a_crowded_key(static):
    spark = static
    data = [("hot", i) for i in range(0, 300)] + [(f"k{i % 50}", i) for i in range(300, 900)] + [(None, 1000), (None, 1001)]
    rows = tables.cut(spark.createDataFrame(data, "k string, i long"))
    want = Counter((k, a, b) for k in {k for k, _ in data if k} for a, b in combinations(sorted(i for x, i in data if x == k), 2))
    for most in (10_000, 40, 7):
        met = tables.meetings(rows, ["k"], "i", most).select("k", "a.i", F.col("b.i").alias("j"))
        assert Counter(map(tuple, met.collect())) == want
    got = sizes(tables.meetings(rows, ["k"], "i", 20))
    assert got[0] < 0.2 * sum(got)


def test_numbered_rows(spark):
    df = spark.createDataFrame([(w,) for w in "banana split".split() + list("zyx")], "w string")
    assert [tuple(r) for r in tables.numbered_rows(df, [F.asc("w")], "no").orderBy("no").collect()] == [(w, i) for i, w in enumerate(sorted("banana split".split() + list("zyx")))]


def test_tables_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    df = tables.cut(spark.createDataFrame([("x" * 1000, [1, 2])] * 20, "s string, v array<int>"))
    assert tables.fits(df)
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 10_000)
    assert not tables.fits(df) and tables.fits(df.limit(3))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 2)
    assert not tables.fits(df.limit(3))


def test_a_table_instead_of_another_leaves_one(spark):
    one = tables.cut(spark.range(3).toDF("i"))
    two = tables.cut(one.selectExpr("i + 1 i"), instead_of=one)
    assert not os.path.exists(one._folder) and sorted(r.i for r in two.collect()) == [1, 2, 3]


def test_no_local_folder_on_a_cluster():
    class Spark:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_dir(Spark)
