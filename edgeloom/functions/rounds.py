"""Materialised rounds for fixpoint loops, and scans over a global order without a single-task window."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, deleted at its end. A temporary folder serves only a local master,
    where driver and executors are one process."""
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.gettempdir()}/checkpoints"
        _roots[sc.applicationId] = root = f"{base.rstrip('/')}/graph-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete, spark, root)
    return _roots[sc.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jvm is None or sc._jsc is None:  # the application has ended
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str = "round") -> DataFrame:
    """Write once under spark.checkpoint.dir and read back: cuts lineage and size estimates, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what materialize wrote for this frame, once nothing reads it any more."""
    if df is not None:
        _delete(df.sparkSession, df._scratch)


ROWS = 1_000_000  # of pairs or edges that one task groups or sorts


def sized(df: DataFrame, rows: int | None) -> DataFrame:
    """df, with the most rows that it can have noted on it."""
    df._rows = rows
    return df


def size_of(df: DataFrame) -> int | None:
    """What ``sized`` has noted on this frame, if anything."""
    return df.__dict__.get("_rows")


def keep_size(df: DataFrame, change, times: int = 1) -> DataFrame:
    """change(df), noted to have at most `times` as many rows as df."""
    return sized(change(df), None if size_of(df) is None else times * size_of(df))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: Spark's setting or fewer for small ones, and enough that none gets over ROWS of them."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 20_000), -(-rows // ROWS))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by `keys` to as many tasks as `rows` rows ask for; adaptive execution leaves that number."""
    return df.repartition(tasks_for(df.sparkSession, rows), *keys)


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """df dealt by ranges of `order` (columns or names), with the range's number in `_part`; written, so that it is one dealing."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size_of(df) is None else tasks_for(df.sparkSession, size_of(df))
    return materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, value: str, order: list, out: str, before: bool = False) -> DataFrame:
    """Adds the sum of `value` over all rows up to each one (before: without it) in the total order `order`.

    Sums inside ranges are windows of one range each; the ranges' own totals are one small row per partition.
    """
    ranged = _ranged(df, order)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))
    ahead = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    local = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.withColumn("_local", local).join(F.broadcast(ahead), "_part")  # as many rows as partitions
    total = F.col("_local") + F.col("_ahead")
    return sized(joined.withColumn(out, (total - F.col(value) if before else total).cast("long")).drop("_part", "_local", "_ahead"), size_of(df))


def row_numbers(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds 1, 2, 3, ... in the total order `order`: places inside sorted ranges are numbered as these are written."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if size_of(df) is None else tasks_for(df.sparkSession, size_of(df))
    place = F.monotonically_increasing_id()  # the partition's number, then 33 bits for the row in it
    ranged = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.shiftright(place, 33)).withColumn("_local", place.bitwiseAND((1 << 33) - 1)), "ranges")
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_total"))
    ahead = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    joined = ranged.join(F.broadcast(ahead), "_part")  # as many rows as partitions
    return sized(joined.withColumn(out, (F.col("_local") + F.col("_ahead") + 1).cast("long")).drop("_part", "_local", "_ahead"), size_of(df))


def next_value(df: DataFrame, value: str, order: list, out: str) -> DataFrame:
    """Adds the value of the next row in the total order `order` (null for the last row)."""
    ranged = _ranged(df, order)
    firsts = ranged.groupBy("_part").agg(F.min_by(F.col(value), F.struct(*order)).alias("_first"))
    after = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_after"))
    local = F.lead(value).over(Window.partitionBy("_part").orderBy(*order))
    last = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(c).desc() for c in order])) == 1
    joined = ranged.withColumn("_local", local).withColumn("_last", last).join(F.broadcast(after), "_part")
    return sized(joined.withColumn(out, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_local"))).drop("_part", "_local", "_last", "_after"), size_of(df))
