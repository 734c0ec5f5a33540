"""Shared plumbing of the training-data operators: tables, scratch space, marks on rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

__all__ = ["UPPER", "LOWER", "among", "ascii_lower", "discard", "fresh", "materialize", "scratch", "ship", "table", "without_redundant", "written"]

_roots: dict[str, str] = {}

#: ASCII lower case only: other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark's readers need to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. A temporary folder serves only a local master (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.gettempdir()}/checkpoints"
        _roots[app] = root = f"{base.rstrip('/')}/edgeloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, root)
    return _roots[app]


def _forget(spark: SparkSession, root: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: rows of a scratch table for which one more file is worth while; each file costs a task, and on a local disk several processes
FILE_ROWS = 1 << 12


def written(df: DataFrame, path: str, most: int | None = None, a_file: int = FILE_ROWS) -> DataFrame:
    """Write to a scratch path and read back. Where the caller knows that df's last stage reads and gives at most so many rows or
    so, a small table becomes two files a core at most, however many partitions the shuffle before it has."""
    if most is not None:
        df = df.coalesce(min(1 << 30, max(2 * df.sparkSession.sparkContext.defaultParallelism, 1 + most // a_file)))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, most: int | None = None, a_file: int = FILE_ROWS) -> DataFrame:
    """Write once into the shared scratch folder and read back: cuts lineage and statistics, survives lost executors."""
    return written(df, fresh(df.sparkSession, name), most, a_file)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: of the table that marks rows; 2^20 words of 64 bits, whatever the number of rows
MARK_BITS = 26


def among(rows: DataFrame, chosen: DataFrame, flag: str) -> DataFrame:
    """rows (doc_id, xh, ...) with a boolean column: true for every row whose (doc_id, xh) is in chosen, and for few others.

    chosen must be written. Its rows set bits in a table of at most 2^MARK_BITS, sized by their number, whose words are
    broadcast (at most 16 MB). So the other rows need no shuffle; beyond some 10^8 chosen rows more and more of them pass.
    """
    bits = min(MARK_BITS, max(10, (16 * chosen.count()).bit_length()))
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "xh"), 64 - bits)
    words = chosen.select(mark.alias("_mark")).groupBy(F.shiftright("_mark", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_mark & 63 as int))")).alias("_bits"))
    joined = rows.withColumn("_mark", mark).withColumn("_word", F.shiftright("_mark", 6)).join(F.broadcast(words), "_word", "left")
    return joined.withColumn(flag, F.expr("coalesce(shiftrightunsigned(_bits, cast(_mark & 63 as int)) & 1, 0) = 1")).drop("_mark", "_word", "_bits")


def without_redundant(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs without the rows that verdicts (doc_id, xh, stays) reject; those it keeps stay once, rows it does not name all stay.

    The rows' own columns travel in one struct, so their names clash with nothing."""
    verdicts = materialize(verdicts.distinct(), "verdicts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("xh"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = among(rows, verdicts, "named")
    own = rows.where("named").withColumn("at", F.monotonically_increasing_id())
    told = verdicts.select(F.col("doc_id").alias("d"), F.col("xh").alias("x"), "stays")
    judged = own.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xh") == F.col("x")), "left").where("stays is null or stays")
    once = judged.withColumn("at", F.when(F.col("stays").isNull(), F.col("at"))).dropDuplicates(["doc_id", "xh", "at"])
    return rows.where("not named").select("row.*").unionByName(once.select("row.*"))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)
