"""Edge files as a stream: batches of files come in, and counts follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import by_task
from ..sources.edge_files import _EDGE, _MATRIX, decode, exists, parse_tsv


def stream_tsv(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """src, dst, val of text files as they appear, at most `files` per micro-batch; a malformed line raises as in the batch reader."""
    return parse_tsv(spark.readStream.option("maxFilesPerTrigger", files).text(path))


def stream_binary(spark: SparkSession, path: str, kind: str, files: int = 1) -> DataFrame:
    """src, dst, val of binary files (kind bel or bmtx) as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files).load(path)
    return rows.select("content").mapInArrow(decode(kind), _MATRIX if kind == "bmtx" else _EDGE)


def closed_by(new: DataFrame, old: DataFrame) -> DataFrame:
    """a, b, c (a < b < c): the triangles of old and new edges (u, v) together that have a new edge.

    Only edges that touch a new edge's end are looked at: a hub elsewhere costs nothing. They go by blocks, marked if they are
    new, so each triangle is found once and no wedge is shuffled."""
    touched = new.select(F.explode(F.array("u", "v")).alias("x")).distinct()
    near = old
    for end in "uv":
        near = near.join(touched.select(F.col("x").alias(end), F.lit(True).alias(f"at_{end}")), end, "left")
    near = near.where("at_u or at_v").select("u", "v", F.lit(0).alias("new"))
    both = near.unionByName(new.select("u", "v", F.lit(1).alias("new"))).groupBy("u", "v").agg(F.max("new").cast("long").alias("new"))

    def work(task):
        for e, xz, yz in task.triangles():
            fresh = np.flatnonzero(task.xy.mark[e] | task.xz.mark[xz] | task.yz.mark[yz])
            yield list(np.sort(np.stack(task.nodes_of(e[fresh], xz[fresh])), axis=0))

    return by_task(both, work, "a long, b long, c long", mark="new")


def recount(edges: DataFrame, store: str, checkpoint: str, found: list):
    """Adds each micro-batch to the edge store (one folder a batch, so a repeated batch replaces itself) and keeps the number of
    triangles: only those that the batch's new edges close are counted, and added to the number before."""
    spark = edges.sparkSession

    def stored(name: str, schema: str, number: int) -> DataFrame:
        path = f"{store}/{name}"
        rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
        return rows.where(F.col("batch") < number)

    def each(batch: DataFrame, number: int) -> None:
        got = batch.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
        old = stored("edges", "u long, v long, batch long", number).select("u", "v")
        before = stored("counts", "triangles long, batch long", number).agg(F.coalesce(F.max_by("triangles", "batch"), F.lit(0)).alias("n")).first()["n"]
        got.join(old, ["u", "v"], "left_anti").write.mode("overwrite").parquet(f"{store}/edges/batch={number}")
        new = spark.read.schema("u long, v long").parquet(f"{store}/edges/batch={number}")
        total = before + closed_by(new, old).count()
        spark.range(1).select(F.lit(total).cast("long").alias("triangles")).write.mode("overwrite").parquet(f"{store}/counts/batch={number}")
        found.append((number, total))

    return edges.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
