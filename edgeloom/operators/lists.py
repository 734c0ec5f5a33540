"""Sorted lists and their expansion: intersection, membership, bounds, merge path, load balance, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounds import row_numbers, running_sum


def intersection_count(a, b):
    """Shared elements of two array columns of distinct elements."""
    return F.size(F.array_intersect(a, b)).cast("long")


def members(needles: DataFrame, haystack: DataFrame, on: list[str]) -> DataFrame:
    """Needles that the haystack holds."""
    return needles.join(haystack.select(*on), on, "left_semi")


def bounds(needles: DataFrame, haystack: DataFrame, upper: bool = False) -> DataFrame:
    """needle id, bound: how many haystack values (column v) lie below needle value v (upper: or equal it).

    The haystack is counted by value first, so a hot value is one row; needles (id, v) and values are then scanned once in
    one order. On ties the haystack goes first for upper bounds.
    """
    hay_tag, needle_tag = (0, 1) if upper else (1, 0)
    hay = haystack.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    both = hay.select(F.lit(None).cast("long").alias("id"), "v", F.lit(hay_tag).alias("tag"), "n").unionByName(needles.select("id", "v", F.lit(needle_tag).alias("tag"), F.lit(0).cast("long").alias("n")))
    return running_sum(both, "n", ["v", "tag", "id"], "bound").where("id is not null").select("id", "bound")


def search(needles: DataFrame, haystack: DataFrame, upper: bool = False) -> DataFrame:
    """needle id, bound as in ``bounds``, found: whether the haystack holds the needle's value."""
    values = haystack.select("v").distinct().withColumn("hit", F.lit(True))
    found = needles.join(values, "v", "left").select("id", F.coalesce("hit", F.lit(False)).alias("found"))
    return bounds(needles, haystack, upper).join(found, "id").select("id", "bound", "found")


def merge_path(a: DataFrame, b: DataFrame, diagonals: list[int], upper: bool = False) -> DataFrame:
    """diagonal, a_index: how many of the first `diagonal` merged values come from a; ties take a first, or b for upper."""
    both = a.select("v", "k", F.lit(int(upper)).alias("side"), F.lit(1).alias("from_a")).unionByName(b.select("v", "k", F.lit(int(not upper)).alias("side"), F.lit(0).alias("from_a")))
    ranked = row_numbers(both, ["v", "side", "k"], "rn")
    cuts = ranked.withColumn("diagonal", F.explode(F.array(*map(F.lit, diagonals)))).where(F.col("rn") <= F.col("diagonal"))
    found = cuts.groupBy("diagonal").agg(F.sum("from_a").alias("a_index"))
    all_ = a.sparkSession.createDataFrame([(d,) for d in diagonals], "diagonal int")
    return all_.join(F.broadcast(found), "diagonal", "left").select(F.col("diagonal").cast("long").alias("diagonal"), F.coalesce("a_index", F.lit(0)).cast("long").alias("a_index"))


def load_balance(work: DataFrame) -> DataFrame:
    """item, obj, rank for objects (obj, cnt): cnt work items each, numbered on through all objects."""
    starts = running_sum(work.where("cnt > 0"), "cnt", ["obj"], "start", before=True)
    items = starts.select("obj", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cnt").cast("long") - 1)).alias("rank"))
    return items.select((F.col("start") + F.col("rank")).alias("item"), "obj", "rank")


def tiles(degrees: DataFrame, size: int = 512) -> DataFrame:
    """src, tile: rows of `degree` cut into tiles of `size` neighbours."""
    return degrees.where("degree > 0").select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("degree") - 1) / size).cast("long"))).alias("tile"))
