"""Cross decomposition: equal-sized, well-connected parts by alternating sweeps over rows and columns.

A node's cost for part p is h * conn(p) + (1 - h) * (n - (card(p) + degree - conn(p))), conn(p) counting neighbours in p. Nodes try
parts by descending cost (ties: smaller part); a part takes nodes by descending cost (ties: smaller id) up to its capacity.
The start is id mod parts, or drawn with a seed. Costs are kept as integers, times 10, so results are exact. A part's cut is
found in the histogram of its costs; only nodes at the very cost of the cut are ranked, by ranges of their ids. So no task
holds a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounds import materialize, row_numbers
from ..session import SEED

H10 = 9  # h = 0.9


def start(nodes: DataFrame, parts: int, seed: int | None = None) -> DataFrame:
    """node, part: id mod parts, or by a hash drawn with the seed."""
    key = F.col("node") if seed is None else F.xxhash64("node", F.lit(seed))
    return nodes.select("node", F.pmod(key, F.lit(parts)).cast("long").alias("part"))


def capacities(n: int, parts: int) -> list[int]:
    """Each part's room: the last takes the remainder."""
    return [n // parts] * (parts - 1) + [n - n // parts * (parts - 1)]


def sweep(edges: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """New node, part from the labels of all neighbours; edges are symmetric (src, dst)."""
    n = labels.count()
    room = capacities(n, parts)
    card = {r["part"]: r["c"] for r in labels.groupBy("part").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row a part
    conn = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.count(F.lit(1)).alias("degree"), *(F.sum((F.col("part") == p).cast("long")).alias(f"c{p}") for p in range(parts)))
    cost = lambda p: H10 * F.col(f"c{p}") + (10 - H10) * (F.lit(n) - (F.lit(card.get(p, 0)) + F.col("degree") - F.col(f"c{p}")))
    ranked = F.sort_array(F.array(*(F.struct(cost(p).alias("cost"), F.lit(-p).alias("neg")) for p in range(parts))), asc=False)
    full = labels.select("node").join(conn.withColumnRenamed("src", "node"), "node", "left").fillna(0)
    left = materialize(full.select("node", ranked.alias("choices")), "choices")
    done = None
    for turn in range(parts):
        want = left.select("node", "choices", (-F.get("choices", F.lit(turn))["neg"]).cast("long").alias("part"), F.get("choices", F.lit(turn))["cost"].alias("cost"))
        placed = _placed(want, room)
        for r in placed.where("in").groupBy("part").agg(F.count(F.lit(1)).alias("c")).collect():
            room[r["part"]] -= r["c"]
        got = placed.where("in").select("node", "part")
        done = got if done is None else done.unionByName(got)
        left = placed.where("not in").select("node", "choices")
    return done


def _placed(want: DataFrame, room: list[int]) -> DataFrame:
    """want (node, choices, part, cost) with in: whether the part takes the node."""
    open_ = F.create_map(*(F.lit(x) for p, n in enumerate(room) for x in (p, n)))[F.col("part").cast("int")]
    counted = want.groupBy("part", "cost").agg(F.count(F.lit(1)).alias("k"))  # as many rows as different costs
    above = F.sum("k").over(Window.partitionBy("part").orderBy(F.col("cost").desc()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
    levels = counted.withColumn("room", open_ - above).select("part", "cost", "k", "room")
    dealt = materialize(want.join(levels, ["part", "cost"]).withColumn("in", F.col("k") <= F.col("room")), "placed")
    ties = dealt.where("not in and room > 0").select("part", "node", "room")
    if not ties.limit(1).count():
        return dealt.select("node", "choices", "part", "in")
    ranked = materialize(row_numbers(ties, ["part", "node"], "rn"), "ties")
    first = ranked.groupBy("part").agg((F.min("rn") - 1).alias("before"))  # one row a part
    taken = ranked.join(F.broadcast(first), "part").where(F.col("rn") - F.col("before") <= F.col("room")).select("node", F.lit(True).alias("tied"))
    return materialize(dealt.join(taken, "node", "left").select("node", "choices", "part", (F.col("in") | F.coalesce("tied", F.lit(False))).alias("in")), "placed")


def cross_decompose(edges: DataFrame, parts: int, sweeps: int = 2, seed: int | None = None) -> DataFrame:
    """node, part after alternating sweeps. Without a seed the session's option holds."""
    seed = seed if seed is not None else edges.sparkSession.conf.get(SEED, None)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = materialize(start(nodes, parts, None if seed is None else int(seed)), "labels")
    for _ in range(sweeps):
        labels = materialize(sweep(edges, labels, parts), "labels")
    return labels


def edge_matrix(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """p_src, p_dst, edges: directed edges between parts, self loops left out."""
    a = labels.select(F.col("node").alias("src"), F.col("part").alias("p_src"))
    b = labels.select(F.col("node").alias("dst"), F.col("part").alias("p_dst"))
    return edges.where("src <> dst").join(a, "src").join(b, "dst").groupBy("p_src", "p_dst").agg(F.count(F.lit(1)).alias("edges"))


def summary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """part, nodes, inner (directed edges within the part), outer (those that leave it)."""
    cells = edge_matrix(edges, labels)
    same = F.col("p_src") == F.col("p_dst")
    sums = cells.groupBy(F.col("p_src").alias("part")).agg(F.sum(F.when(same, F.col("edges")).otherwise(0)).alias("inner"), F.sum(F.when(same, 0).otherwise(F.col("edges"))).alias("outer"))
    nodes = labels.groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(sums, "part", "left").select("part", "nodes", F.coalesce("inner", F.lit(0)).alias("inner"), F.coalesce("outer", F.lit(0)).alias("outer"))


def rename(labels: DataFrame) -> DataFrame:
    """node, new_id: consecutive ids part by part, in node order."""
    return row_numbers(labels, ["part", "node"], "new_id").select("node", (F.col("new_id") - 1).alias("new_id"))
