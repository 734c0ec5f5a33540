"""From edges to adjacency: filters, orientation, degrees, offsets, column bins, cardinalities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounds import dealt, keep_size, row_numbers, running_sum, size_of


def build(edges: DataFrame, keep=None, dedup: bool = True, loops: bool = False) -> DataFrame:
    """Directed edges (src, dst) that satisfy `keep`; without repeats and self loops unless asked."""
    out = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *[c for c in edges.columns if c == "val"])
    out = out if keep is None else out.where(keep)
    out = out if loops else out.where("src <> dst")
    if dedup and size_of(edges) is not None:
        out = dealt(out, size_of(edges), "src", "dst")
    return out.dropDuplicates(["src", "dst"]) if dedup else out


def orient_upper(edges: DataFrame) -> DataFrame:
    return edges.where("src < dst")


def orient_lower(edges: DataFrame) -> DataFrame:
    return edges.where("src > dst")


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) in any direction to (u, v) with u < v."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def symmetric(graph: DataFrame) -> DataFrame:
    """(u, v) to both directions."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return keep_size(graph, lambda g: g.select(ends.alias("e")).select("e.*"), 2)


def degrees(graph: DataFrame) -> DataFrame:
    """node, degree of (u, v)."""
    return graph.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def orient_by_degree(graph: DataFrame) -> DataFrame:
    """(src, dst) from the end of lower degree (then smaller id) to the other: bounds every out-degree by the root of 2m."""
    d = degrees(graph)
    e = graph.join(d.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    return e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("dst"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, nbrs (sorted) of directed edges."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def vertices(edges: DataFrame) -> DataFrame:
    """Every row 0..max id with its degree, empty rows included."""
    top = edges.agg(F.max(F.greatest("src", "dst")).alias("m")).first()["m"]
    rows = edges.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", "src")
    return rows.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src", "left").select("src", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stats(edges: DataFrame) -> DataFrame:
    """nnz, num_rows (largest id + 1), num_nodes (distinct ends), max_degree (of rows) of directed edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.countDistinct("n").alias("num_nodes"), (F.coalesce(F.max("n"), F.lit(-1)) + 1).alias("num_rows"))
    rows = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("nnz"), F.coalesce(F.max("d"), F.lit(0)).alias("max_degree"))
    return rows.crossJoin(ends).select("nnz", "num_rows", "num_nodes", "max_degree")  # one row each


def size_bytes(nnz: int, num_rows: int) -> int:
    """Bytes of a compressed row layout with 64-bit offsets and ids."""
    return 8 * (nnz + num_rows + 1)


def row_ptr(edges: DataFrame) -> DataFrame:
    """src, degree, start: each row's first place among all edges."""
    d = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return running_sum(d, "degree", ["src"], "start", before=True)


def binned(edges: DataFrame, parts: int = 8, num_rows: int | None = None) -> DataFrame:
    """Adds part: dst's column partition; the last takes what is over. Without num_rows the largest id is found in the same job."""
    width = lambda rows: F.greatest(F.lit(1), F.ceil(rows / parts))
    if num_rows is None:
        top = edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(0)) + 1).alias("_rows"))
        edges, rows = edges.crossJoin(F.broadcast(top)), F.col("_rows")  # one row
    else:
        rows = F.lit(num_rows)
    return edges.withColumn("part", F.least(F.floor(F.col("dst") / width(rows)), F.lit(parts - 1)).cast("long")).drop("_rows")


def part_view(bins: DataFrame, first: int, last: int) -> DataFrame:
    """Edges whose part lies in first..last-1."""
    return bins.where((F.col("part") >= first) & (F.col("part") < last))


def edge_ids(edges: DataFrame) -> DataFrame:
    """Adds edge_id: the place in (src, dst) order, from 0."""
    out = row_numbers(edges, ["src", "dst"], "edge_id")
    return keep_size(out, lambda x: x.withColumn("edge_id", F.col("edge_id") - 1))


def reverse_ids(edges: DataFrame) -> DataFrame:
    """edge_id, reverse_id of edges whose reverse is there too. Both directions of two ends meet in one group, so ids are shuffled
    once and joined with nothing."""
    ids = edge_ids(edges).select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), *(F.when(way, F.col("edge_id")).alias(x) for x, way in (("f", F.col("src") <= F.col("dst")), ("b", F.col("src") >= F.col("dst")))))
    ids = ids if size_of(edges) is None else dealt(ids, size_of(edges), "u", "v")
    both = ids.groupBy("u", "v").agg(F.collect_list("f").alias("fs"), F.collect_list("b").alias("bs")).where("size(fs) > 0 and size(bs) > 0")
    pairs = both.select("u", "v", F.explode("fs").alias("f"), "bs").select("u", "v", "f", F.explode("bs").alias("b"))
    turned = F.when(F.col("u") == F.col("v"), F.array(F.struct("f", "b"))).otherwise(F.array(F.struct("f", "b"), F.struct(F.col("b").alias("f"), F.col("f").alias("b"))))
    return pairs.select(F.explode(turned).alias("p")).select(F.col("p.f").alias("edge_id"), F.col("p.b").alias("reverse_id"))
