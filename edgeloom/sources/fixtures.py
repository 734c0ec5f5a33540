"""Graphs made from the given tables: undirected simple edges (u, v) with u < v."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounds import dealt, keep_size, next_value, size_of, sized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(rows: DataFrame, group: str, node: str) -> DataFrame:
    """u, v, n: two nodes of one group, u < v, and n pairs of rows that join them in it; dealt by u.

    A group's nodes come together as one list, so rows are shuffled once. Tasks are as many as rows, then pairs, ask for: by
    the bytes that are read Spark would take too few, since a row makes many pairs and a pair takes more room in a table.
    """
    one = rows.select(F.col(group).alias("g"), F.col(node).alias("u")).where("g is not null and u is not null")
    one = dealt(one, rows.count(), "g")
    sizes = one.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1.0) / 2")).alias("pairs")).first()
    ones = one.groupBy("g", "u").agg(F.count(F.lit(1)).alias("n"))
    lists = ones.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("u", "n"))).alias("all"))
    left = lists.select("all", F.posexplode("all").alias("i", "x"))
    pairs = left.select(F.col("x.u").alias("u"), F.col("x.n").alias("k"), F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y"))
    n = int(sizes["pairs"] or 0)
    return sized(dealt(pairs.select("u", F.col("y.u").alias("v"), (F.col("k") * F.col("y.n")).alias("n")), n, "u"), n)


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the same order."""
    return keep_size(_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"), lambda p: p.select("u", "v").distinct())


def supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of the same part (complete in the given tables)."""
    return keep_size(_pairs(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey"), lambda p: p.select("u", "v").distinct())


def weighted_part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_graph with val: pairs of lines that join the two parts."""
    return keep_size(_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"), lambda p: p.groupBy("u", "v").agg(F.sum("n").alias("val")))


def user_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of consecutive events."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    rows = next_value(sized(events, events.count()), "user_id", ["ts", "event_id"], "after")
    pairs = rows.where("after is not null and user_id <> after")
    return sized(pairs.select(F.least("user_id", "after").alias("u"), F.greatest("user_id", "after").alias("v")).distinct(), size_of(rows))
