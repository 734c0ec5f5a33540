"""Connected components: forests within partitions, then alternating large and small stars, in rounds written to the scratch folder.

Each partition first replaces its edges by stars around the smallest node of what they connect, so that a chain or a dense
group whose edges meet in one partition costs no rounds. Partitions hold EDGES_PER_TASK edges or so at any size of input.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship


EDGES_PER_TASK = 200_000
MOST_NODES = 1_000_000  # of one forest in memory; beyond that it is emitted and a new one begun


def _forest(batches):
    """Edges (a, b) as stars: every node of what this partition connects, with the smallest of them; larger node first."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars():
        found = [(x, find(x)) for x in list(parent)]
        found = [e for e in found if e[0] != e[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > MOST_NODES:
            yield stars()
    yield stars()


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _round(edges: DataFrame) -> DataFrame:
    """edges (a, b) with b < a. Large star: neighbours above a node move to its smallest neighbour. Small star: the rest."""
    ends = _both(edges)
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = ends.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    # a node's smaller neighbours and the node itself move to the smallest of them
    small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return small.where("a <> b").distinct()


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node it is connected with) for every node of edges (a, b longs) that is no root itself."""
    ship(edges.sparkSession)
    tasks = lambda n: 1 + n // EDGES_PER_TASK
    now = edges.where("a <> b").select("a", "b").coalesce(tasks(edges.count())).mapInArrow(_forest, "a long, b long")
    now, state = materialize(now, "links"), None
    for _ in range(most_rounds):
        then, state = state, now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
        if then == state or not state["n"]:
            break
        now = materialize(_round(now).coalesce(tasks(state["n"])).mapInArrow(_forest, "a long, b long"), "stars")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``stars`` with a row for every root as well."""
    now = stars(edges, most_rounds)
    return now.unionByName(now.select(F.col("root").alias("node"), "root").distinct())
