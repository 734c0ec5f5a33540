"""Edge files: whitespace text (dst src weight), 24-byte binary records (dst, src, weight), and 1-based binary matrices.

Text is read and written by Spark. Binary files go through Arrow batches and numpy, a file per task; the distributed writers
make one or more files per partition, on any file system that pyarrow reaches by the path's scheme.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

RECORD = 24  # bytes: three little-endian 64-bit fields
HEADER = 24  # of a binary matrix: rows, columns, entries
SLICE = 100_000  # records of an Arrow batch
FILE = 1_000_000  # records of a binary file that a task writes; a task holds one file's records
BEL = np.dtype([("dst", "<u8"), ("src", "<u8"), ("val", "<u8")])
BMTX = np.dtype([("src", "<i8"), ("dst", "<i8"), ("val", "<f8")])
_EDGE = "src long, dst long, val long"
_MATRIX = "src long, dst long, val double"


def _integer(field):
    """A signed integer as C reads it: decimal, 0x for base 16, a leading 0 for base 8; null if it is none."""
    sign = F.when(field.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(field, "^[+-]", "")
    number = F.when(digits.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(digits, 3, 40), 16, 10)).when(digits.rlike("^0[0-7]+$"), F.conv(digits, 8, 10)).when(digits.rlike("^(0|[1-9][0-9]*)$"), digits)
    return F.try_multiply(number.try_cast("long"), sign)


def parse_tsv(lines: DataFrame) -> DataFrame:
    """src, dst, val of text lines (value) with the fields dst src weight; a line without them raises when it is read."""
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    parts = F.split(text, " ")

    def field(i: int):
        number = _integer(F.get(parts, F.lit(i)))
        return F.when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("malformed edge: "), F.col("value"))))

    return lines.where(text != "").select(field(1).alias("src"), field(0).alias("dst"), field(2).alias("val"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, val of a text file with columns dst src weight; a malformed line raises when it is read."""
    return parse_tsv(spark.read.text(path))


def decode(kind: str):
    """Arrow batches of file contents to Arrow batches of edges; a short tail is no record."""
    record, skip, base = (BMTX, HEADER, 1) if kind == "bmtx" else (BEL, 0, 0)
    names, kinds = ["src", "dst", "val"], [pa.int64(), pa.int64(), pa.float64() if kind == "bmtx" else pa.int64()]

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                raw = data.as_buffer()
                rows = np.frombuffer(raw, record, max(0, raw.size - skip) // RECORD, min(skip, raw.size))
                for at in range(0, len(rows), SLICE):
                    part = rows[at : at + SLICE]
                    columns = [part["src"], part["dst"], part["val"]]
                    if kind == "bel":
                        if any((c >> np.uint64(63)).any() for c in columns[:2]):
                            raise ValueError("an id of 2^63 or more does not fit")
                        columns = [c.astype(np.int64) for c in columns]  # weights keep their bits
                    else:
                        columns = [columns[0] - base, columns[1] - base, columns[2]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def read_bel(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, val of binary edge lists: a file, or a folder as write_bel_parts makes it. One task reads one file."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode("bel"), _EDGE)


def read_bmtx(spark: SparkSession, path: str) -> DataFrame:
    """src, dst (from 0), val double of binary matrix files."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode("bmtx"), _MATRIX)


def bmtx_metadata(spark: SparkSession, path: str) -> DataFrame:
    """num_rows, num_cols, nnz from each binary matrix file's header."""

    def run(batches):
        for batch in batches:
            heads = [np.frombuffer(x.as_py(), "<u8", 3).astype(np.int64).tolist() for x in batch.column("head")]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in heads], pa.int64()) for i in range(3)], ["num_rows", "num_cols", "nnz"])

    return spark.read.format("binaryFile").load(path).select(F.substring("content", 1, HEADER).alias("head")).mapInArrow(run, "num_rows long, num_cols long, nnz long")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Reads by the path's suffix."""
    readers = {".bel": read_bel, ".tsv": read_tsv, ".bmtx": read_bmtx}
    for suffix, reader in readers.items():
        if path.rstrip("/").endswith(suffix):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}: expected one of {', '.join(readers)}")


def _weighted(edges: DataFrame) -> DataFrame:
    return edges if "val" in edges.columns else edges.withColumn("val", F.lit(1))


def write_tsv(edges: DataFrame, path: str) -> None:
    """Text with columns dst, src, weight; fails if path exists."""
    _weighted(edges).select(F.concat_ws("\t", "dst", "src", F.col("val").cast("string"))).write.text(path)


def _records(batch, kind: str) -> np.ndarray:
    rows = np.empty(batch.num_rows, BMTX if kind == "bmtx" else BEL)
    for name in rows.dtype.names:
        rows[name] = batch.column(name).to_numpy() + (1 if kind == "bmtx" and name != "val" else 0)
    return rows


def write_bel(edges: DataFrame, path: str) -> int:
    """A single local binary edge list, streamed through the driver partition by partition; refuses to overwrite. Returns the
    edges written. ``write_bel_parts`` writes in the tasks."""
    ship(edges.sparkSession)
    n = 0
    with open(path, "xb") as file:
        for row in _weighted(edges).select(*(F.col(c).cast("long") for c in BEL.names)).mapInArrow(_packed, "body binary").toLocalIterator(prefetchPartitions=True):
            file.write(row["body"])
            n += len(row["body"]) // RECORD
    return n


def _packed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_records(batch, "bel").tobytes()], pa.binary())], ["body"])


def _pieces(batches, kind: str, most: int):
    """Records of a partition in runs of at most `most`; one empty run if there are none."""
    held, n, ran = [], 0, False
    for batch in batches:
        rows = _records(batch, kind)
        while len(rows):
            held.append(rows[: most - n])
            rows, n = rows[most - n :], n + len(held[-1])
            if n == most:
                yield np.concatenate(held)
                held, n, ran = [], 0, True
    if n or not ran:
        yield np.concatenate([np.empty(0, BMTX if kind == "bmtx" else BEL), *held])


def _write_parts(edges: DataFrame, path: str, kind: str, shape: tuple[int, int] | None = None) -> int:
    if exists(edges.sparkSession, path):
        raise FileExistsError(path)
    ship(edges.sparkSession)
    name, most = uuid.uuid4().hex[:8], FILE
    base = path if "://" in path else f"file://{path}"

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        n = 0
        for i, records in enumerate(_pieces(batches, kind, most)):
            part = f"{folder}/part-{task.partitionId():05d}-{i:04d}-{name}.{kind}"
            hidden = f"{folder}/_{task.partitionId()}-{i}-{task.taskAttemptId()}"  # readers pass over it
            with store.open_output_stream(hidden) as file:
                if shape:  # each file's header holds the number of its records
                    file.write(np.array([*shape, len(records)], "<u8").tobytes())
                file.write(records.tobytes())
            store.move(hidden, part)  # a retried task replaces its own file
            n += len(records)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = _weighted(edges).select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("val").cast("double" if kind == "bmtx" else "long"))
    return sum(r["n"] for r in rows.mapInArrow(run, "n long").collect())  # a number a task


def write_bel_parts(edges: DataFrame, path: str) -> int:
    """A folder of binary edge lists of at most FILE edges, written by the tasks, each one or more; refuses to overwrite. Returns the
    edges written."""
    return _write_parts(edges, path, "bel")


def write_bmtx_parts(edges: DataFrame, path: str, num_rows: int, num_cols: int) -> int:
    """A folder of binary matrices of one shape, of at most FILE entries, written by the tasks, each one or more. Returns the entries
    written."""
    return _write_parts(edges, path, "bmtx", (num_rows, num_cols))
