"""Structured Streaming over drop folders: ingest with deduplication, running counts, backlog cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrove.functions.text import normalised_doi


def record_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records as they are dropped into a folder; broken lines are left out."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def distinct_dois(stream: DataFrame, time: str = "harvested_at", within: str = "7 days") -> DataFrame:
    """The first record of each normalised DOI within the watermark; records without DOI all pass.

    State per DOI is dropped once the watermark is past, so it is bounded by the records of that span. A record of null
    time is compared as any other, but is itself remembered only until the watermark moves.
    """
    keyed = stream.withColumn("_doi", normalised_doi("doi"))
    key = F.when(F.col("_doi") == "", F.concat(F.lit("id:"), F.col("rec_id").cast("string"))).otherwise(F.col("_doi"))
    return keyed.withColumn("_key", key).withWatermark(time, within).dropDuplicatesWithinWatermark(["_key"]).drop("_doi", "_key")


def windowed_counts(stream: DataFrame, time: str, by: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, by, n): events per window and value; events later than ``late`` are left out."""
    n = stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("window.start").alias("start"), by, "n")


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to a table of files, exactly once, until all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots(stream: DataFrame, seen, checkpoint: str):
    """Calls ``seen(batch, number)`` for every batch of what is there."""
    return stream.writeStream.foreachBatch(seen).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
