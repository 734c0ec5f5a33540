"""Reference graphs with known triangle counts, as directed edges (src, dst) in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def complete(spark: SparkSession, n: int) -> DataFrame:
    """All ordered pairs of different nodes 0..n-1."""
    pairs = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"))).alias("dst"))
    return pairs.where("src <> dst")


def complete_triangles(n: int) -> int:
    return n * (n - 1) * (n - 2) // 6


def hubspoke(spark: SparkSession, spokes: int) -> DataFrame:
    """A path of `spokes` nodes, and a hub (the last node) joined with each of them."""
    to_hub = spark.range(spokes).select(F.col("id").alias("a"), F.lit(spokes).cast("long").alias("b"))
    path = spark.range(max(spokes - 1, 0)).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    both = to_hub.unionByName(path)
    return both.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def hubspoke_triangles(spokes: int) -> int:
    return max(spokes - 1, 0)
