"""Plan helpers: reading tables, cutting lineage in the shared folder, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType
from pyspark.sql.window import Window

#: A lookup side is broadcast up to this many rows and bytes, both counted; beyond either the salted shuffle join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32 << 20
#: Keys with more rows than this are hot, and get a slice for each so many rows they have.
HOT_ROWS = 200_000
#: The most hot keys: where there could be more, a key is hot beyond this part of all rows, which is less than a task's share.
HOT_KEYS = 10_000
#: Rows of one key that one task pairs with each other.
PAIR_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, as in tests, a local one of this process; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not at and not _own:
        _own.append(tempfile.mkdtemp(prefix="citegrove-"))
    return (at or _own[0]).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the JVM ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def cut(df: DataFrame, name: str = "cut", instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: short lineage that outlives lost executors.

    ``instead_of`` is a table of this kind that nothing will read again, as that of the round before; it is deleted.
    """
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._folder = at
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(df: DataFrame) -> None:
    """Delete the table behind a result of cut."""
    at = getattr(df, "_folder", None)
    if at:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about."""
    parts = [F.lit(16 * len(df.columns))]
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            parts.append(F.coalesce(F.length(F.to_json(F.struct(f.name))), F.lit(0)))
    return sum(parts[1:], parts[0]).cast("long")


def fits(df: DataFrame) -> bool:
    """Whether a table, counted in rows and bytes, may be broadcast. It should be cheap to read (see cut)."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes")).first()
    return n.rows <= BROADCAST_ROWS and n.bytes <= BROADCAST_BYTES


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, hot_rows: int | None = None, how: str = "inner") -> DataFrame:
    """Join of many rows with a lookup that holds each key once and, in ``weight``, the key's number of rows.

    A key with over ``hot_rows`` rows is spread over one slice for each so many of them, whether its rows are equal or
    not; its lookup row is repeated once per slice. At most HOT_KEYS keys are hot, so their list is broadcast.
    ``lookup`` should be cheap to read twice (see cut). ``how`` is inner or left.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    least = lookup.agg(F.greatest(F.lit(hot_rows), F.ceil(F.coalesce(F.sum(weight), F.lit(0)) / HOT_KEYS)).alias("_least"))  # one row
    sliced = lookup.crossJoin(F.broadcast(least)).withColumn("_slices", F.ceil(F.col(weight) / F.col("_least")).cast("int")).drop("_least")
    hot = sliced.filter(F.col("_slices") > 1).select(*keys, "_slices")
    mixed = F.xxhash64(F.monotonically_increasing_id())
    spread = F.when(F.col("_slices") > 1, F.pmod(mixed, F.col("_slices")))
    if how == "left":  # rows without a key meet nothing, wherever they go
        spread = spread.when(F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False)), F.pmod(mixed, F.lit(1 << 20)))
    spread = spread.otherwise(F.lit(0)).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_slice", spread).drop("_slices")
    every = F.when(F.col("_slices") > 1, F.sequence(F.lit(0), F.col("_slices") - 1)).otherwise(F.array(F.lit(0)))
    return left.join(sliced.withColumn("_slice", F.explode(every)).drop("_slices"), [*keys, "_slice"], how).drop("_slice")


def hot_keys(lookup: DataFrame, keys: list[str], weight: str) -> DataFrame | None:
    """(keys, _slices) of the hot keys of a lookup as salted_join has them, written once for joins that are repeated; None where no key is hot."""
    found = lookup.agg(F.greatest(F.lit(HOT_ROWS), F.ceil(F.coalesce(F.sum(weight), F.lit(0)) / HOT_KEYS)).alias("least"), F.max(weight).alias("most")).first()
    if (found.most or 0) <= found.least:
        return None
    return cut(lookup.filter(F.col(weight) > found.least).select(*keys, F.ceil(F.col(weight) / found.least).cast("int").alias("_slices")), "hot")


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join with a lookup, the rows of hot keys (see hot_keys) over their slices and the lookup's repeated for each."""
    if hot is None:
        return rows.join(lookup, keys)
    slices = F.coalesce("_slices", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_slice", F.pmod(F.xxhash64(F.monotonically_increasing_id()), slices).cast("int")).drop("_slices")
    right = lookup.join(F.broadcast(hot), keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    return left.join(right, [*keys, "_slice"]).drop("_slice")


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Broadcast while the lookup is small (see fits), else the salted shuffle join."""
    if fits(lookup):
        return rows.join(F.broadcast(lookup), keys, how)
    return salted_join(rows, lookup, keys, weight, how=how)


def meetings(rows: DataFrame, keys: list[str], order: str, pair_rows: int | None = None) -> DataFrame:
    """(keys, a, b): every two rows of one key, once, as structs of the other columns, a before b by ``order``.

    ``rows`` should be cheap to read twice (see cut); ``order`` differs within a key, and rows without a key meet none.
    The rows of a key with over ``pair_rows`` of them are dealt into blocks and each two blocks meet in a task of their
    own, so that no task pairs more than pair_rows with as many.
    """
    pair_rows = PAIR_ROWS if pair_rows is None else pair_rows
    other = [c for c in rows.columns if c not in keys]
    crowded = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > pair_rows)
    crowded = cut(crowded, "crowded")
    sides = [F.struct(*other).alias(x) for x in "ab"]

    def met(r: DataFrame, by: list[str]) -> DataFrame:
        return r.select(*by, sides[0]).join(r.select(*by, sides[1]), by)

    if crowded.isEmpty():
        return met(rows, keys).filter(F.col(f"a.{order}") < F.col(f"b.{order}"))
    calm = met(rows.join(F.broadcast(crowded) if fits(crowded) else crowded, keys, "left_anti"), keys).filter(F.col(f"a.{order}") < F.col(f"b.{order}"))
    dealt = lookup_join(rows, crowded, keys, "_n").withColumn("_blocks", F.ceil(F.col("_n") / pair_rows).cast("int"))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(order), F.col("_blocks")).cast("int"))
    one = dealt.select(*keys, F.struct(*other).alias("a"), F.col("_block").alias("_i"), F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)).alias("_j"))
    two = dealt.select(*keys, F.struct(*other).alias("b"), F.col("_block").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_i"))
    pairs = one.join(two, [*keys, "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col(f"a.{order}") < F.col(f"b.{order}")))
    first = F.col(f"a.{order}") < F.col(f"b.{order}")
    turned = pairs.select(*keys, F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))
    return calm.unionByName(turned)


def running_total(df: DataFrame, order: list[Column], value: str, blocks: int | None = None) -> DataFrame:
    """df with ``rank`` (from 1) and ``upto`` (sum of value so far) over the whole order, without one task seeing all rows.

    Rows are range-partitioned by the order; only the rows and sum of each partition meet, of which there are at most
    ``blocks``, by default the session's shuffle partitions. The partitions are written, since their bounds are sampled
    and would not be the same a second time.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(blocks, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("_part").orderBy(*order)
    local = parts.withColumn("_r", F.row_number().over(inner)).withColumn("_s", F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy("_part").agg(F.max("_r").alias("_n"), F.sum(value).alias("_v"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = ends.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v0"))
    out = local.join(F.broadcast(offsets), "_part")
    return out.withColumn("rank", F.col("_r") + F.col("_n0")).withColumn("upto", F.col("_s") + F.col("_v0")).drop("_part", "_r", "_s", "_n0", "_v0")


def numbered_rows(df: DataFrame, order: list[Column], name: str, blocks: int | None = None) -> DataFrame:
    """df with ``name``: the place of each row in the order, from 0. ``blocks`` as in running_total."""
    return running_total(df.withColumn("_one", F.lit(1)), order, "_one", blocks).withColumn(name, (F.col("rank") - 1).cast("long")).drop("_one", "rank", "upto")
