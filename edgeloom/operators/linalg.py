"""Sparse matrices as (src, dst, val)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounds import materialize, size_of
from ..session import ship
from . import blocks

SQUARE = 2_000_000  # groups of rows, and of columns, are the root of the entries over this


def elementwise(a: DataFrame, b: DataFrame) -> DataFrame:
    """a .* b on a's pattern; zeros are stored."""
    other = b.select("src", "dst", F.col("val").alias("other"))
    return a.join(other, ["src", "dst"], "left").select("src", "dst", F.coalesce(F.col("val") * F.col("other"), F.lit(0)).cast(a.schema["val"].dataType).alias("val"))


def compress(a: DataFrame) -> DataFrame:
    """Without stored zeros."""
    return a.where("val <> 0")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The matrix product."""
    right = b.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("val").alias("other"))
    return a.withColumnRenamed("dst", "mid").join(right, "mid").groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("val") * F.col("other")).alias("val"))


def product_figures(a: DataFrame, b: DataFrame, rows: int | None = None) -> DataFrame:
    """nnz and total of the product of matrices of whole numbers: stored entries and their sum, without the product's rows.

    Rows of a and columns of b fall into groups by a hash. A task has a group of rows and one of columns, and all that a and b
    hold there, packed; it forms the products of a few rows at a time. So edges are sent once for each group, never products.
    """
    spark = a.sparkSession
    ship(spark)
    rows = rows or size_of(a)
    if rows is None:
        a = materialize(a, "factor")
        rows = a.count()
    n = max(1 if rows < 100_000 else 4 if rows < 5_000_000 else 16, math.isqrt(rows // SQUARE) + 1)
    side = lambda m, key, role: m.where("src is not null and dst is not null and val is not null").select("src", "dst", F.col("val").cast("long").alias("val"), F.pmod(F.xxhash64(key), F.lit(n)).alias("g"), F.lit(role).alias("role"))

    def split(batches):
        for src, dst, val, g, role in blocks.columns_of(batches, blocks.CHUNK):
            part = (src.view(np.uint64) * blocks.ODD >> np.uint64(61)).astype(np.int64)  # of eight, of the rows on the left
            for code, body in blocks.pieces((role.astype(np.int64) * n + g) * 8 + part * (role == 0), src, dst, val):
                code, part = divmod(code, 8)
                goes = [code * n + i for i in range(n)] if code < n else [i * n + code - n for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([goes], pa.list_(pa.int32())), pa.array([part if code < n else -1], pa.int32()), pa.array([body], pa.binary())], ["tasks", "part", "body"])

    def multiplied(batches):
        held: dict = {}
        for batch in batches:
            for task, part, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right = held.setdefault(task, ({}, []))
                (right if part < 0 else left.setdefault(part, [])).append(body)
        for left, right in held.values():
            nnz, total = _figures(left, right)
            yield pa.RecordBatch.from_arrays([pa.array([nnz]), pa.array([total], pa.string())], ["nnz", "total"])

    packed = (side(m, key, role).mapInArrow(split, "tasks array<int>, part int, body binary") for m, key, role in ((a, "src", 0), (b, "dst", 1)))
    chunks = next(packed).unionByName(next(packed)).select(F.explode("tasks").alias("task"), "part", "body")
    found = chunks.repartitionById(n * n, F.col("task")).mapInArrow(multiplied, "nnz long, total string")
    return found.agg(F.coalesce(F.sum("nnz"), F.lit(0)).alias("nnz"), F.sum(F.when(F.col("nnz") > 0, F.col("total").cast("decimal(38,0)"))).cast("long").alias("total"))


def _figures(left: dict, right: list[bytes]) -> tuple[int, str]:
    """Entries of the product of packed matrices, and their sum as text, for it may pass 64 bits before it is added up. What is on
    the right is held in a few bytes an entry, what is on the left packed but for the rows of one part."""
    if not left or not right:
        return 0, "0"
    ends = [[np.unique(c) for c in blocks.decode(body)[:2]] for body in right]
    mids, ys = (np.unique(np.concatenate(c)) for c in zip(*ends, strict=True))
    row, y, b = [], [], []
    for i, j, v in map(blocks.decode, right):
        v = v.view(np.int64)
        row.append(np.searchsorted(mids, i).astype(np.int32))
        y.append(np.searchsorted(ys, j).astype(np.int32))
        b.append(v.astype(np.result_type(np.min_scalar_type(v.min()), np.min_scalar_type(v.max()))))
    row, y, b = (np.concatenate(c) for c in (row, y, b))
    order = np.argsort(row, kind="stable")
    y, b = y[order], b[order]
    size = np.bincount(row)
    first, most = np.cumsum(size) - size, max(abs(int(b.min())), abs(int(b.max()))) * int(size.max())
    sums = np.add.reduceat(b, first, dtype=np.int64) if most < 2**62 else np.add.reduceat(b.astype(object), first)
    found = [_part_figures(bodies, mids, first, size, y, sums, most, len(ys)) for bodies in left.values()]
    return sum(n for n, _ in found), str(sum(t for _, t in found))


def _part_figures(bodies, mids, first, size, y, sums, most: int, wide: int) -> tuple[int, int]:
    x, mid, a = (np.concatenate(c) for c in zip(*map(blocks.decode, bodies), strict=True))
    at = np.minimum(np.searchsorted(mids, mid), len(mids) - 1)
    hit = mids[at] == mid
    x, at, a = x[hit], at[hit], a.view(np.int64)[hit]
    if not len(x):
        return 0, 0
    small = max(abs(int(a.min())), abs(int(a.max()))) * most * len(a) < 2**62
    total = int((a * sums[at]).sum()) if small else sum(int(i) * int(j) for i, j in zip(a, sums[at], strict=True))
    order = np.argsort(x, kind="stable")
    x, at, nnz = x[order], at[order], 0
    cuts = np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)]
    work = np.cumsum(size[at])[cuts[1:] - 1]  # products up to each row's end
    lo = 0
    while lo < len(work):  # whole rows of the product
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + blocks.SLAB, "right")))
        of = slice(cuts[lo], cuts[hi])
        n = size[at[of]]
        place = np.arange(n.sum()) + np.repeat(first[at[of]] - (np.cumsum(n) - n), n)
        rows = np.repeat(np.searchsorted(cuts, np.arange(of.start, of.stop), "right") - 1 - lo, n)
        keys = np.sort(rows * np.int64(wide) + y[place])
        nnz += 1 + int(np.count_nonzero(keys[1:] != keys[:-1]))
        lo = hi
    return nnz, total


def axpy(df: DataFrame, a: str, x, y: str, out: str = "val") -> DataFrame:
    """out = a * x + y."""
    return df.withColumn(out, F.col(a) * x + F.col(y))


def fill(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.lit(value))


def zero(df: DataFrame, column: str) -> DataFrame:
    return fill(df, column, 0)
