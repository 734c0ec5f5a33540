"""Triangle counts: one meaning, several plans. Graphs are simple undirected edges (u, v) with u < v.

All go by blocks of edges (``blocks``): a plan is what a task does with the edges of its three groups. Lists are met from the
shorter one, so a hub's neighbours are never looked through on each of its edges. Wedges, words and products are formed a slab
at a time inside a task; none is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounds import keep_size, size_of
from ..session import STRATEGY
from .blocks import Task, by_task, counted, expand, groups_for


def _oriented(graph: DataFrame) -> DataFrame:
    return keep_size(graph, lambda g: g.select(F.col("u").alias("src"), F.col("v").alias("dst")))


def _sorted(task: Task, places) -> np.ndarray:
    """Three rows: the triangles' ids, ascending."""
    e, xz, _ = places
    return np.sort(np.stack(task.nodes_of(e, xz)), axis=0)


def triangle_list(graph: DataFrame) -> DataFrame:
    """a, b, c with a < b < c."""
    return by_task(graph, lambda task: (list(_sorted(task, t)) for t in task.triangles()), "a long, b long, c long")


def _total(column):
    return F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("triangles")


def _counts(graph: DataFrame, count) -> DataFrame:
    """The sum of count(task): one number a task."""
    return by_task(graph, lambda task: [[[count(task)]]], "n long").agg(_total("n"))


def _met(task: Task) -> int:
    return sum(len(e) for e, _, _ in task.triangles())


def count_array(graph: DataFrame) -> DataFrame:
    """Lists of neighbours intersected on each edge."""
    return _counts(graph, _met)


def count_degree(graph: DataFrame) -> DataFrame:
    """As count_array, for graphs with hubs: both start at the end with fewer neighbours in the task."""
    return _counts(graph, _met)


def count_wedge(graph: DataFrame) -> DataFrame:
    """Wedges closed by a join."""
    return _counts(graph, lambda task: sum(len(e) for e, _, _ in task.triangles(shorter=False)))


def _words(side):
    """Rows of a block as 64-bit words: key (row, word), bits, and each row's first word."""
    keys = side.x.astype(np.int64) * (side.wide // 64 + 1) + (side.y >> 6)
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (side.y & 63).astype(np.uint64), new) if len(new) else np.empty(0, np.uint64)
    return keys[new], bits, np.searchsorted(side.x[new], np.arange(len(side.start)))


def _shared_bits(task: Task) -> int:
    (left, a, start), (right, b, first), n = _words(task.xz), _words(task.yz), 0
    width = task.xz.wide // 64 + 1
    x, y = task.xy.x.astype(np.int64), task.xy.y.astype(np.int64)
    short = start[x + 1] - start[x] < first[y + 1] - first[y]
    for edges, mine, its, begin, keys, bits, there, other in ((short, x, y, start, left, a, right, b), (~short, y, x, first, right, b, left, a)):
        mine, its = mine[edges], its[edges]
        for which, place in expand(begin[mine], begin[mine + 1]):
            want = its[which] * width + keys[place] % width
            at = np.minimum(np.searchsorted(there, want), max(0, len(there) - 1))
            hit = there[at] == want if len(there) else np.zeros(len(at), bool)
            n += int(np.bitwise_count(bits[place[hit]] & other[at[hit]]).sum())
    return n


def count_bitmap(graph: DataFrame) -> DataFrame:
    """Rows as 64-bit words: for dense id ranges."""
    return _counts(graph, _shared_bits)


def _masked_product(task: Task) -> int:
    n, yz = 0, task.yz
    for which, place in expand(yz.start[task.xy.y], yz.start[task.xy.y + 1]):
        keys, paths = counted(task.xy.x[which].astype(np.int64) * task.xz.wide + yz.y[place])
        n += int(paths[task.xz.find(*np.divmod(keys, task.xz.wide))[0]].sum())
    return n


def count_spgemm(graph: DataFrame) -> DataFrame:
    """sum((A A) .* A)."""
    return _counts(graph, _masked_product)


def task_counts(graph: DataFrame, parts: int = 4) -> DataFrame:
    """i, j, k, triangles: partial counts of the tasks that compare rows of block i with rows of block j over columns of block
    k. Tasks without a triangle are left out; all others sum to the whole."""
    rows = size_of(graph)
    groups = parts * max(1, -(-groups_for(rows) // parts)) if rows else parts  # each block of nodes is one group or several

    def work(task):
        block = [np.full(len(ids), g % parts) for g, ids in zip(task.groups, (task.x, task.y, task.z), strict=True)]
        n = np.zeros(parts**3, np.int64)
        for e, xz, _ in task.triangles():
            ids = np.stack(task.nodes_of(e, xz))
            i, j, k = np.take_along_axis(np.stack([block[0][task.xy.x[e]], block[1][task.xy.y[e]], block[2][task.xz.y[xz]]]), np.argsort(ids, axis=0), axis=0)
            n += np.bincount((i * parts + j) * parts + k, minlength=len(n))
        at = np.flatnonzero(n)
        yield [at // parts**2, at // parts % parts, at % parts, n[at]]

    return by_task(graph, work, "i long, j long, k long, n long", groups=groups).groupBy("i", "j", "k").agg(_total("n"))


def count_blocks(graph: DataFrame, parts: int = 4) -> DataFrame:
    """Sum over tasks (i, j, k) of row, column and comparison blocks: bounds each task's lists."""
    return task_counts(graph, parts).agg(_total("triangles"))


STRATEGIES = {"array": count_array, "wedge": count_wedge, "bitmap": count_bitmap, "spgemm": count_spgemm, "blocks": count_blocks, "degree": count_degree}


def triangle_count(graph: DataFrame, strategy: str | None = None) -> DataFrame:
    """triangles. auto: by degree where some node has over 16 times the mean degree, else by id. Without a strategy the
    session's option holds."""
    strategy = strategy or graph.sparkSession.conf.get(STRATEGY, "auto")
    if strategy == "auto":
        from .build import degrees

        r = degrees(graph).agg(F.max("degree").alias("top"), F.avg("degree").alias("mean")).first()
        strategy = "degree" if r["top"] and r["top"] > 16 * r["mean"] else "array"
    return STRATEGIES[strategy](graph)


def _by(graph: DataFrame, columns: str, of) -> DataFrame:
    """Triangles by the columns that of(a, b, c) makes, counted in each task first."""

    def work(task):
        for t in task.triangles():
            yield counted(*of(*_sorted(task, t)))

    return by_task(graph, work, ", ".join(f"{c} long" for c in [*columns, "n"])).groupBy(*columns).agg(F.sum("n").alias("n"))


def edge_support(graph: DataFrame) -> DataFrame:
    """u, v, support: triangles on each edge, 0 included."""
    found = _by(graph, "uv", lambda a, b, c: (np.concatenate([a, b, a]), np.concatenate([b, c, c])))
    return graph.select("u", "v").join(found, ["u", "v"], "left").select("u", "v", F.coalesce("n", F.lit(0)).alias("support"))


def common_counts(graph: DataFrame) -> DataFrame:
    """u, v, n: the larger nodes that the ends of an edge share; edges without any are left out."""
    return _by(graph, "uv", lambda a, b, c: (a, b))


def vertex_triangles(graph: DataFrame) -> DataFrame:
    """src, triangles: those whose smallest node is src; rows without any are left out."""
    return _by(graph, ["src"], lambda a, b, c: (a,)).withColumnRenamed("n", "triangles")


def _open_rows(graph: DataFrame) -> DataFrame:
    """Edges (u, v) whose end v has larger neighbours itself: the only ones that a row-wise count looks at."""
    return graph.select("u", "v").join(graph.select(F.col("u").alias("v")).distinct(), "v", "left_semi")


def range_counts(graph: DataFrame, width: int) -> DataFrame:
    """bucket, triangles: partial counts over row ranges of `width` ids; they sum to the whole."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long").alias("bucket")
    found = _by(graph, ["bucket"], lambda a, b, c: (a // width,))
    return _open_rows(graph).select(bucket("u")).distinct().join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("triangles"))


def edge_range_counts(graph: DataFrame, width: int) -> DataFrame:
    """bucket, triangles: partial counts over ranges of `width` edges in (src, dst) order."""
    from .build import edge_ids

    ids = edge_ids(_oriented(graph)).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.floor(F.col("edge_id") / width).cast("long").alias("bucket"))
    looked = _open_rows(graph).join(ids, ["u", "v"]).join(common_counts(graph), ["u", "v"], "left")
    return looked.groupBy("bucket").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("triangles"))
