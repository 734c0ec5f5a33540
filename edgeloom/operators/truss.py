"""k-trusses: edges with at least k-2 triangles among the edges kept. Graphs are simple undirected edges (u, v), u < v."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounds import discard, materialize, sized
from .build import degrees
from .blocks import Task, by_task, decode, groups_for, pieces
from .triangles import triangle_list


def node_eliminate(graph: DataFrame, w: int) -> DataFrame:
    """Edges both of whose ends have degree w or more."""
    fit = degrees(graph).where(F.col("degree") >= w).select("node")
    return graph.join(fit.withColumnRenamed("node", "u"), "u", "left_semi").join(fit.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v")


def _triangles(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered edges and triangles of edge numbers, listed once."""
    edges = materialize(graph.select("u", "v", F.monotonically_increasing_id().alias("e")), "edges")
    t = triangle_list(edges)
    for x, y, name in (("a", "b", "e1"), ("b", "c", "e2"), ("a", "c", "e3")):
        t = t.join(edges.select(F.col("u").alias(x), F.col("v").alias(y), F.col("e").alias(name)), [x, y])
    return edges, materialize(t.select("e1", "e2", "e3"), "triangles")


SIDES = ("e1", "e2", "e3")


def _support(live: DataFrame) -> DataFrame:
    """e, s: triangles on each edge that has any."""
    return live.select(F.explode(F.array(*SIDES)).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("s"))


def _without(live: DataFrame, dead: DataFrame) -> DataFrame:
    for side in SIDES:
        live = live.join(dead.withColumnRenamed("e", side), side, "left_anti")
    return live


def _by_edge(live: DataFrame) -> DataFrame:
    """Every triangle once for each of its edges e."""
    return materialize(live.select(F.explode(F.array(*SIDES)).alias("e"), *SIDES), "by-edge")


def _peel(live: DataFrame, k: int) -> tuple[DataFrame, list[dict]]:
    """Triangles (e1, e2, e3) of the k-truss, and the rounds' figures.

    Support is counted once. Then only the frontier matters: the edges that fall below in a round take their triangles with
    them, and only the other edges of these triangles lose support. Triangles stay where they are written, dead ones among
    them, until over a tenth has died; then they are written anew without them.
    """
    rounds, n = [], live.count()
    if not n:
        return live, rounds
    views, support, dead, since = _by_edge(live), materialize(_support(live), "support"), None, 0
    while n:
        weak = materialize(support.where(F.col("s") < k - 2).select("e"), "weak")
        gone = weak.count()
        rounds.append({"k": k, "triangles": n, "deleted": gone})
        if not gone:
            break
        hit = views.join(weak, "e", "left_semi").select(*SIDES).distinct()
        hit = materialize(hit if dead is None else _without(hit, dead), "lost")
        fell = hit.count()
        lost = _support(hit).withColumnRenamed("s", "l")
        left = support.join(weak, "e", "left_anti").join(lost, "e", "left").select("e", (F.col("s") - F.coalesce("l", F.lit(0))).alias("s"))
        left = materialize(left, "support")
        for old in (support, hit):
            discard(old)
        support, n, since = left, n - fell, since + fell
        dead = weak if dead is None else dead.unionByName(weak)
        if n and 10 * since > n:
            old, views = views, materialize(_without(views, dead), "by-edge")
            discard(old)
            dead, since = None, 0
    if not n:
        return live.where("false"), rounds
    left = views.where("e = e1").select(*SIDES)
    return materialize(left if dead is None else _without(left, dead), "live"), rounds


def _edges_of(live: DataFrame) -> DataFrame:
    return live.select(F.explode(F.array(*SIDES)).alias("e")).distinct()


def _supported(graph: DataFrame, rows: int, least: int) -> DataFrame:
    """u, v of the edges in `least` triangles or more. Tasks pack their counts by the edges' owners, some 4 bytes a count; an owner
    adds up a part of the edges."""
    owners = max(1, groups_for(rows) ** 2)

    def work(task: Task):
        sides = [(s, np.zeros(len(s.keys), np.int64)) for s in (task.xy, task.xz, task.yz)]
        for places in task.triangles():
            for (_, n), at in zip(sides, places, strict=True):
                n += np.bincount(at, minlength=len(n))
        for (side, n), (xs, ys) in zip(sides, ((task.x, task.y), (task.x, task.z), (task.y, task.z)), strict=True):
            at = np.flatnonzero(n)
            if len(at):
                x, y = xs[side.x[at]], ys[side.y[at]]
                owner = ((x * 31 + y).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % owners
                found = list(pieces(owner, x, y, n[at]))
                yield [pa.array([i for i, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())]

    def added(batches):
        bodies = [b for batch in batches for b in batch.column("body").to_pylist()]
        if bodies:
            x, y, n = (np.concatenate(c) for c in zip(*map(decode, bodies), strict=True))
            order = np.lexsort((y, x))
            x, y, n = x[order], y[order], n[order].view(np.int64)
            new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            keep = new[np.add.reduceat(n, new) >= least]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[keep], y[keep])), pa.array(np.maximum(x[keep], y[keep]))], ["u", "v"])

    counts = by_task(sized(graph, rows), work, "owner int, body binary")
    return counts.repartitionById(owners, F.col("owner")).select("body").mapInArrow(added, "u long, v long")


def _shrunk(graph: DataFrame, k: int) -> tuple[DataFrame, bool]:
    """Edges that hold the k-truss, and whether they are it: while a round takes a tenth of the edges or more, support is counted
    anew, for that costs less than to write the triangles of edges that go. Whatever the order of peeling, the truss is the same."""
    graph = materialize(graph.select("u", "v"), "edges")
    n = graph.count()
    while n:
        left = materialize(_supported(graph, n, k - 2), "edges")
        kept = left.count()
        discard(graph)
        graph, was, n = left, n, kept
        if kept == was:
            return graph, True
        if 10 * (was - kept) < was:
            break
    return graph, not n


def ktruss(graph: DataFrame, k: int) -> DataFrame:
    """u, v of the k-truss. k <= 2 keeps every edge."""
    if k <= 2:
        return graph.select("u", "v")
    graph, done = _shrunk(graph, k)
    if done:
        return graph
    edges, live = _triangles(graph)
    live, _ = _peel(live, k)
    return edges.join(_edges_of(live), "e", "left_semi").select("u", "v")


def ktruss_pair(graph: DataFrame, low: int, high: int) -> DataFrame:
    """u, v, k: the edges of the low-truss, and k = high for those of the high-truss among them, else low. One peel serves
    both: the high-truss is peeled out of what the low one left."""
    if not 2 < low <= high:
        raise ValueError("2 < low <= high is asked for")
    edges, live = _triangles(node_eliminate(graph, low - 1))
    wide, _ = _peel(live, low)
    narrow, _ = _peel(wide, high)
    both = _edges_of(wide).join(_edges_of(narrow).withColumn("deep", F.lit(True)), "e", "left")
    return edges.join(both, "e").select("u", "v", F.when(F.col("deep"), high).otherwise(low).cast("long").alias("k"))


def truss_rounds(graph: DataFrame, k: int) -> list[dict]:
    """Progress of peeling: triangles and deleted edges per round."""
    return _peel(_triangles(graph)[1], k)[1]


def truss_decomposition(graph: DataFrame, most_rounds: int = 500) -> DataFrame:
    """u, v, truss: the largest k whose truss holds the edge; 2 for edges in no triangle.

    A fixpoint of local h-indexes: each edge's value becomes the h-index, over its triangles, of the smaller value of the
    other two edges, from the support downwards.
    """
    edges, t = _triangles(graph)
    sides = F.array(*(F.struct(F.col(x).alias("e"), F.col(y).alias("f"), F.col(z).alias("g")) for x, y, z in (("e1", "e2", "e3"), ("e2", "e1", "e3"), ("e3", "e1", "e2"))))
    views = materialize(t.select(F.explode(sides).alias("s")).select("s.*"), "views")
    now = materialize(views.groupBy("e").agg(F.count(F.lit(1)).alias("h")), "support")
    state = None
    for _ in range(most_rounds):
        total = now.agg(F.sum("h").alias("t")).first()["t"]
        if total is None or total == state:
            break
        state = total
        seen = views.join(now.select(F.col("e").alias("f"), F.col("h").alias("x")), "f").join(now.select(F.col("e").alias("g"), F.col("h").alias("y")), "g")
        level = seen.groupBy("e", F.least("x", "y").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("e").orderBy(F.col("w").desc()).rowsBetween(Window.unboundedPreceding, 0))
        then = materialize(level.withColumn("above", above).groupBy("e").agg(F.max(F.least("w", "above")).alias("h")), "h-index")
        discard(now)
        now = then
    else:
        raise RuntimeError(f"truss numbers did not settle in {most_rounds} rounds")
    return edges.join(now, "e", "left").select("u", "v", (F.coalesce("h", F.lit(0)) + 2).cast("long").alias("truss"))


def max_truss(graph: DataFrame) -> DataFrame:
    """max_truss: 2 for a graph without triangles, 0 for an empty one."""
    return truss_decomposition(graph).agg(F.coalesce(F.max("truss"), F.lit(0)).cast("long").alias("max_truss"))


def max_truss_binary(graph: DataFrame, low: int = 2, high: int | None = None) -> int:
    """The same by search over k: each probe peels the triangles that the last successful one left. The first pivot lies at a
    fifth of the span, the others in its middle."""
    edges, live = _triangles(graph)
    if not edges.limit(1).count():
        return 0
    if high is None:
        top = _support(live).agg(F.max("s").alias("m")).first()["m"]
        high = (top or 0) + 2
    first = True
    while low < high:
        k = max(low + 1, (4 * low + high) // 5) if first else (low + high + 1) // 2
        first = False
        kept, _ = _peel(live, k)
        if kept.limit(1).count():
            low, live = k, kept
        else:
            high = k - 1
    return low
