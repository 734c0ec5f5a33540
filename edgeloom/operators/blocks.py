"""Triangles by blocks of edges: the shuffle of every count, list and support.

Nodes fall into groups by a hash, and nodes are ordered by group, then id. A task has three groups p <= q <= r, not all different
ones of necessity, and holds the edges between them, so it finds each triangle x < y < z of that order with x in p, y in q, z in
r: every triangle is found once, in one task. An edge goes to as many tasks as there are groups, packed into some 3 bytes, and
neither lists nor wedges are shuffled. Groups grow with the root of the edges, so no task holds more than some 6 EDGES of them.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounds import materialize, size_of
from ..session import ship

EDGES = 1_000_000  # the number of groups is the root of the edges over this
CHUNK = 1_000_000  # edges that are packed at once
SLAB = 1 << 21  # wedges that are formed at once
ODD = np.uint64(0x9E3779B97F4A7C15)


def encode(x, y, mark=None) -> bytes:
    """Sorted edges (x, y), with a 64-bit mark each if given, in a few bytes each: rows and gaps, in the narrowest type."""
    new = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    u, w, low = x[new].view(np.uint64), y.view(np.uint64), y.min().view(np.uint64)
    gaps = np.delete(np.diff(w, prepend=w[:1]), new)
    parts = [np.array([u[0], low], np.uint64), np.diff(u, prepend=u[:1]), (np.diff(np.r_[new, len(x)]) - 1).astype(np.uint64), w[new] - low, gaps]
    if mark is not None:
        parts.append(np.ascontiguousarray(mark).view(np.uint64))
    body = b""
    for a in parts:
        a = a.astype(np.min_scalar_type(a.max()) if len(a) else np.uint8)
        body += np.array([a.itemsize, len(a)], "<u8").tobytes() + a.tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def decode(body: bytes):
    """x, y, mark (None if there is none)."""
    raw, at, parts = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True), 0, []
    while at < len(raw):
        width, n = (int(i) for i in np.frombuffer(raw, "<u8", 2, at))
        parts.append(np.frombuffer(raw, f"<u{width}", n, at + 16).astype(np.uint64))
        at += 16 + width * n
    base, rows, counts, first, gaps, *mark = parts
    counts = counts.astype(np.int64) + 1
    starts = np.cumsum(counts) - counts
    steps, inner = np.zeros(counts.sum(), np.uint64), np.ones(counts.sum(), bool)
    inner[starts] = False
    steps[inner] = gaps
    run = np.cumsum(steps, dtype=np.uint64)
    y = run + np.repeat(base[1] + first - run[starts], counts)
    return np.repeat(base[0] + np.cumsum(rows, dtype=np.uint64), counts).view(np.int64), y.view(np.int64), mark[0] if mark else None


def columns_of(batches, most: int):
    """Lists of numpy columns of at least `most` rows each, but the last."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= most:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def pieces(code, x, y, mark=None):
    """code, positions, packed edges of each code, by (x, y)."""
    order = np.lexsort((y, x, code))
    code, x, y = code[order], x[order], y[order]
    mark = None if mark is None else mark[order]
    cuts = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(code[lo]), encode(x[lo:hi], y[lo:hi], None if mark is None else mark[lo:hi])


def _split(b: int, goes: list[list[int]]):
    """Batches of u, v, their groups and perhaps a mark to packed blocks (p, q), with the tasks that they go to."""

    def run(batches):
        for u, v, g, h, *mark in columns_of(batches, CHUNK):
            turn = (g > h) | ((g == h) & (u > v))
            x, y, p, q = np.where(turn, v, u), np.where(turn, u, v), np.where(turn, h, g), np.where(turn, g, h)
            found = list(pieces(p.astype(np.int64) * b + q, x, y, *mark))
            yield pa.RecordBatch.from_arrays([pa.array([goes[c] for c, _ in found], pa.list_(pa.int32())), pa.array([c for c, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["tasks", "block", "body"])

    return run


class Side:
    """The edges of one block by rows, as places among the nodes of its groups."""

    def __init__(self, x, y, mark, xs, ys):
        self.keys, self.wide = np.searchsorted(xs, x) * np.int64(len(ys)) + np.searchsorted(ys, y), max(1, len(ys))
        if (self.keys[1:] <= self.keys[:-1]).any():
            order = np.argsort(self.keys, kind="stable")
            self.keys, mark = self.keys[order], None if mark is None else mark[order]
        self.x, self.y = (i.astype(np.int32) for i in np.divmod(self.keys, self.wide))
        self.mark, self.start = mark, np.searchsorted(self.x, np.arange(len(xs) + 1))
        self.bits, self.seen = np.uint64(64 - max(10, len(self.keys).bit_length() + 2)), None

    def find(self, x, y):
        """Which of the pairs are edges, and where."""
        if self.seen is None:
            self.seen = np.zeros(1 << (64 - int(self.bits)), bool)
            self.seen[(self.keys.view(np.uint64) * ODD) >> self.bits] = True
        keys = x * np.int64(self.wide) + y
        maybe = np.flatnonzero(self.seen[(keys.view(np.uint64) * ODD) >> self.bits])
        keys = keys[maybe]
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else at[:0]
        return maybe[hit], at[hit]


def expand(start, end):
    """Slabs of (which, place): the places start..end-1 of each row, rows in order."""
    size = end - start
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLAB, "right")))
        n = size[at:upto]
        which = np.repeat(np.arange(at, upto), n)
        yield which, np.arange(len(which)) + np.repeat(start[at:upto] - (np.cumsum(n) - n), n)
        at = upto


class Task:
    """The edges between three groups: xy, xz and yz are the blocks' sides, at their nodes by role."""

    def __init__(self, groups, bodies: dict, b: int):
        p, q, r = groups
        found, nodes = {}, {}
        for g, h in {(p, q), (p, r), (q, r)}:
            parts = [decode(x) for x in bodies.pop(g * b + h, [])]
            x, y = (np.concatenate([c[i] for c in parts]) if parts else np.empty(0, np.int64) for i in (0, 1))
            found[g, h] = x, y, np.concatenate([c[2] for c in parts]) if parts and parts[0][2] is not None else None
            for k, ids in ((g, x), (h, y)):
                nodes.setdefault(k, []).append(np.unique(ids))
        nodes = {k: np.unique(np.concatenate(v)) for k, v in nodes.items()}
        sides = {}
        for g, h in list(found):
            sides[g, h] = Side(*found.pop((g, h)), nodes[g], nodes[h])
        self.groups, self.xy, self.xz, self.yz = groups, sides[p, q], sides[p, r], sides[q, r]
        self.x, self.y, self.z = nodes[p], nodes[q], nodes[r]

    def triangles(self, shorter: bool = True):
        """Slabs of places in xy, xz and yz: the sides of each triangle. Each edge xy looks the nodes of its shorter list up in the
        other one; without `shorter`, always those of y's list: the wedges."""
        xy, xz, yz = self.xy, self.xz, self.yz
        by_x, by_y = xz.start[xy.x + 1] - xz.start[xy.x], yz.start[xy.y + 1] - yz.start[xy.y]
        open_ = (by_x > 0) & (by_y > 0)
        left = by_x < by_y if shorter else np.zeros(len(by_x), bool)
        for from_x in (True, False):
            edges = np.flatnonzero(open_ & (left == from_x))
            here, other, mine, its = (xz, yz, xy.x, xy.y) if from_x else (yz, xz, xy.y, xy.x)
            for which, place in expand(here.start[mine[edges]], here.start[mine[edges] + 1]):
                e = edges[which]
                ok, at = other.find(its[e].astype(np.int64), here.y[place])
                yield (e[ok], place[ok], at) if from_x else (e[ok], at, place[ok])

    def nodes_of(self, e, at):
        """x, y, z of triangles by their places in xy and xz."""
        return self.x[self.xy.x[e]], self.y[self.xy.y[e]], self.z[self.xz.y[at]]


def groups_for(rows: int) -> int:
    return max(1 if rows < 100_000 else 2 if rows < 500_000 else 4, math.ceil(math.sqrt(rows / EDGES)))


def by_task(graph: DataFrame, work, schema: str, mark: str | None = None, groups: int | None = None) -> DataFrame:
    """Rows that work(Task) yields as Arrow arrays, a list of columns each time; the task's blocks have `mark` (long) on their edges."""
    spark = graph.sparkSession
    ship(spark)
    rows = size_of(graph)
    if rows is None:
        graph = materialize(graph, "edges")
        rows = graph.count()
    b = groups or groups_for(rows)
    triples = list(combinations_with_replacement(range(b), 3))
    number = {t: i for i, t in enumerate(triples)}
    goes = [[number[tuple(sorted((p, q, s)))] for s in range(b)] if p <= q else [] for p in range(b) for q in range(b)]
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(b))
    edges = graph.where("u is not null and v is not null").select("u", "v", group("u").alias("gu"), group("v").alias("gv"), *([mark] if mark else []))
    chunks = edges.mapInArrow(_split(b, goes), "tasks array<int>, block int, body binary").select(F.explode("tasks").alias("task"), "block", "body")

    def run(batches):
        held: dict = {}
        for batch in batches:
            for t, block, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(t, {}).setdefault(block, []).append(body)
        for t in list(held):
            for out in work(Task(triples[t], held.pop(t), b)):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return chunks.repartitionById(len(triples), F.col("task")).mapInArrow(run, schema)


def counted(*columns):
    """Distinct rows of the columns, and how often each occurs."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
    columns = [c[order] for c in columns]
    if not len(order):
        return [*columns, np.empty(0, np.int64)]
    new = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    return [*(c[new] for c in columns), np.diff(np.r_[new, len(order)])]
