"""Byte-bounded shards by extendible hashing, in DataFrame operations only.

Rows hash to 60 bits. A directory indexed by a prefix of those bits points to buckets; a bucket whose rows exceed the byte
limit splits on its next bit, all others keep their shorter prefix (local depth). Sums per prefix, not rows, decide: one
aggregate over a fine prefix gives all shallower sums, and only buckets that are too large even there are looked at again.

Defined results: a null text counts 0 bytes. The hash covers the row's key and its text, so rows with one key part unless
they are repeated rows; those share all 60 bits. A bucket that cannot split (one row, or repeated rows, over the limit) is
divided by a running count of whole rows into pages; a single row beyond the limit has a page of its own. An empty table
gives no rows. Extra columns travel in one struct whatever their names; a column named shard makes the folders' key _shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LIMIT = 64 << 20
BITS = 60
FINER = 6  # bits beyond the depth that even shards would need


def _prefix(depth):
    return F.expr(f"shiftright(h, {BITS} - {depth})") if isinstance(depth, int) else F.expr(f"shiftright(h, {BITS} - {depth})")


def keyed(docs: DataFrame, *own) -> DataFrame:
    """doc_id, h (60-bit hash), bytes, and these columns."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.encode(text, "UTF-8"))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"), F.octet_length(text).cast("long").alias("bytes"), *own)


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Buckets: depth, prefix, bytes, rows, solid (still over the limit with all bits used)."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    depth, fine = 0, min(BITS, max(0, (max(total, 1) // limit).bit_length()) + FINER)
    pending, found = None, None
    while True:
        part = rows if pending is None else rows.join(pending, F.expr(f"shiftright(h, {BITS} - {depth})") == pending["q"], "left_semi")
        sums = materialize(part.groupBy(F.expr(f"shiftright(h, {BITS} - {fine})").alias("p")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "prefix-sums")
        each = sums.select(F.explode(F.sequence(F.lit(depth), F.lit(fine))).alias("depth"), "p", "bytes", "rows").withColumn("prefix", F.expr(f"shiftright(p, cast({fine} - depth as int))"))
        level = materialize(each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")), "levels")
        # a bucket stands if it fits and its parent did not; the first level has no parent here
        parent = level.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        fits = level.where(F.col("bytes") <= limit)
        top = fits.where(F.col("depth") == depth) if depth == 0 else fits.where("false")
        leaves = fits.withColumn("up", F.shiftright("prefix", 1)).join(parent, ["depth", "up"], "left_semi").select("depth", "prefix", "bytes", "rows")
        leaves = top.select("depth", "prefix", "bytes", "rows").unionByName(leaves)
        over = level.where((F.col("depth") == fine) & (F.col("bytes") > limit))
        alone = over.where("rows = 1") if fine < BITS else over
        done = leaves.withColumn("solid", F.lit(False)).unionByName(alone.select("depth", "prefix", "bytes", "rows").withColumn("solid", F.lit(True)))
        found = done if found is None else found.unionByName(done)
        if fine >= BITS or not over.where("rows > 1").limit(1).count():
            return materialize(found, "directory")
        pending, depth = over.where("rows > 1").select(F.col("prefix").alias("q")), fine
        fine = min(BITS, fine + 8)


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, depth (local depth of the bucket), prefix (its bits as a number), page (0 unless it cannot split)."""
    return _placed(keyed(docs), limit)


def _placed(rows: DataFrame, limit: int, *own: str) -> DataFrame:
    """The shard of each keyed row, which keeps these columns of its own."""
    rows = materialize(rows, "keyed")
    buckets = directory(rows, limit)
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]  # 61 values at most
    out = None
    # one equi-join on the directory: a row tries its prefix at each depth in use
    tried = rows.withColumn("depth", F.explode(F.array(*map(F.lit, sorted(depths))))) if len(depths) > 1 else rows.withColumn("depth", F.lit(depths[0] if depths else 0))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(h, cast({BITS} - depth as int))"))
    placed = tried.join(buckets.select("depth", "prefix", "solid"), ["depth", "prefix"])
    plain = placed.where("not solid").select("doc_id", "bytes", "depth", "prefix", F.lit(0).cast("long").alias("page"), *own)
    out = plain
    if buckets.where("solid").limit(1).count():
        # rows of a bucket that cannot split are equal in length: pages of so many whole rows, counted task by task
        solid = materialize(placed.where("solid").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "solid")
        keys = ["depth", "prefix"]
        from pyspark.sql import Window

        # repeated rows are dealt to chunks by their number in the file's task; offsets come from sums per chunk
        solid = solid.withColumn("chunk", F.floor(F.col("row") / 4096))
        sums = solid.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("k"), F.max("bytes").alias("each"))
        before = F.sum("k").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
        within = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("row")) - 1
        paged = solid.withColumn("within", within).join(sums, [*keys, "chunk"])
        per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("each", F.lit(1))))
        out = plain.unionByName(paged.select("doc_id", "bytes", "depth", "prefix", F.floor((F.col("before") + F.col("within")) / per).cast("long").alias("page"), *own))
    return out.select("doc_id", "bytes", F.col("depth").cast("long").alias("depth"), "prefix", "page", *own)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write docs as one folder of Parquet files per shard."""
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    placed = _placed(keyed(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")), limit, "own")
    placed.select("own.*", F.concat_ws("-", "depth", "prefix", "page").alias(name)).repartition(name).write.partitionBy(name).parquet(path)
