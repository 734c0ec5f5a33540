"""WARC archives with an external index merge.

Pages become WARC records, one archive per task, written by Spark's text writer: the record's own end (two line ends) is the
writer's separator, so archives land atomically on any Hadoop file system and a retried task leaves nothing behind. Archives
are plain, so an index entry's offset is the record's place in the file. Reading back, each archive gives a capture run: index
entries sorted by URL key, timestamp and page, written to the scratch folder. Runs are cut at common bounds of the key space
into ranges of about RANGE_ROWS entries, and each range is merged by a k-way loser tree over its runs' segments, which are
read in a stream. Ranges in order are the global capture histories.

Records with equal payloads of at least REVISIT_BYTES are revisits of the one with the largest page_id.

Defined results: null html is an empty payload, null url an empty URL; a URL that cannot be parsed is its own key, in lower
case. Timestamps follow page ids second by second and start anew every SPAN ids, so any id has one. Repeated rows are written
and indexed one by one; of repeated page_ids with one payload all are responses. A null page_id is never referred to. An empty
table gives no entries. Very long payloads are read record by record; an archive is held in memory whole, so its size is what
a task wrote. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, fresh, materialize, ship

REVISIT_BYTES = 1000
END = "\r\n\r\n"
#: Timestamp of page 0; the others follow it second by second, up to SPAN (some 31 years).
EPOCH = "2024-01-01T00:00:00Z"
SPAN = 10**9
RANGE_ROWS = 100_000  # index entries that one task merges
SLICE = 2_000  # entries of a segment that are unpacked at a time
SALTS = 16


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then path and query, in lower case."""
    try:
        parts = urlsplit(url.lower())
        host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


class LoserTree:
    """Merges sorted runs: inner nodes keep the losers of their matches, so each output costs one walk to the root."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        self.winner = self._build()

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _build(self) -> int:
        winners = [0] * (2 * self.k)
        winners[self.k :] = range(self.k)
        for i in range(self.k - 1, 0, -1):
            a, b = winners[2 * i], winners[2 * i + 1]
            winners[i], self.tree[i] = (a, b) if self._beats(a, b) else (b, a)
        return winners[1] if self.k > 1 else 0

    def __iter__(self):
        while self.heads[self.winner] is not None:
            now = self.winner
            yield self.heads[now]
            self.heads[now] = next(self.runs[now], None)
            at = (now + self.k) // 2
            while at:
                if self._beats(self.tree[at], now):
                    self.tree[at], now = now, self.tree[at]
                at //= 2
            self.winner = now


def records(pages: DataFrame) -> DataFrame:
    """One string per record: WARC headers and, for responses, the payload."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_replace("url", "[\r\n]", ""), F.lit("")).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    rows = rows.withColumn("xh", F.xxhash64("digest"))
    # one small row per repeated payload, dealt by digest and salt; no payload is shuffled but those of pages that may be revisits
    large = materialize(rows.where(F.col("size") >= REVISIT_BYTES).select("doc_id", "xh", "digest"), "digests")
    shared = large.groupBy("digest").agg(F.max("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marks = large.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(shared, ["digest", "salt"]).where("not doc_id <=> first")
    marks = materialize(marks.select("doc_id", "xh", "digest", "first").distinct(), "revisits")
    rows = among(rows, marks, "named")
    told = marks.select(F.col("doc_id").alias("p"), F.col("digest").alias("d"), "first")
    again = rows.where("named").join(told, F.col("doc_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")
    rows = rows.where("not named").withColumn("first", F.lit(None).cast("long")).unionByName(again).withColumnRenamed("doc_id", "page_id")
    revisit = F.col("first").isNotNull()
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH), "yyyy-MM-dd'T'HH:mm:ssX") + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
            line("WARC-Target-URI", F.col("url")),
            line("WARC-Date", date),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            line("WARC-Payload-Length", F.col("size").cast("string")),
            F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))))).otherwise(""),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
            F.lit("\r\n"),
            F.when(revisit, F.lit("")).otherwise(F.col("html")),
        ).alias("value")
    )


def write(pages: DataFrame, path: str) -> str:
    """Write archives of pages (page_id, url, html) under path."""
    records(pages).write.option("lineSep", END).text(path)
    return path


def parse(data: bytes):
    """Offset, headers and payload of each record; raises on a payload that does not meet its digest."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:cut].decode().split("\r\n")[1:] if ": " in x)
        size = int(head["Content-Length"])
        body = data[cut + 4 : cut + 4 + size]
        if data[cut + 4 + size : cut + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end")
        if head["WARC-Type"] == "response" and "sha1:" + hashlib.sha1(body).hexdigest() != head["WARC-Payload-Digest"]:
            raise ValueError(f"record at {at} has a wrong payload digest")
        yield at, head, body
        at = cut + 8 + size


_ENTRY = "url_key string, timestamp string, page_id long, digest string, size long, type string, refers_to long, archive string, offset long"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]


def _number(urn: str | None):
    digits = (urn or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def _order(entry) -> tuple:
    return (entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[7], entry[8])


def _runs(batches):
    """The sorted capture run of each archive."""
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            raw = data.as_py()
            name = path.rsplit("/", 1)[-1]
            run = [(url_key(h.get("WARC-Target-URI", "")), h["WARC-Date"], _number(h["WARC-Record-ID"]), h["WARC-Payload-Digest"][5:], int(h["WARC-Payload-Length"]), h["WARC-Type"], _number(h.get("WARC-Refers-To")), name, at) for at, h, _ in parse(raw)]
            run.sort(key=_order)
            columns = list(zip(*run, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)), pa.array(range(len(run)), pa.int64())], [*_NAMES, "at"])


def _segment(parts: list):
    """The entries of one run in a range, unpacked slice by slice."""
    for part in parts:
        for at in range(0, part.num_rows, SLICE):
            for e in zip(*(c.to_pylist() for c in part.slice(at, SLICE).columns), strict=True):
                yield _order(e), e


def _merge(batches):
    """Rows come sorted by range, archive and place in the run: segments of runs, merged range by range. A range is held as
    Arrow columns; only a slice of each segment is unpacked at a time."""

    def merged(segments):
        tree = iter(LoserTree(_segment(parts) for parts in segments))
        while part := list(itertools.islice(tree, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(e for _, e in part), strict=True), _KINDS, strict=True)], _NAMES)

    now, segments = None, {}
    for batch in batches:
        ranges, archives, own = batch.column("range").to_pylist(), batch.column("archive").to_pylist(), batch.select(_NAMES)
        at = 0
        for (place, archive), run in itertools.groupby(zip(ranges, archives, strict=True)):
            size = sum(1 for _ in run)
            if place != now:
                yield from merged(segments.values())
                now, segments = place, {}
            segments.setdefault(archive, []).append(own.slice(at, size))
            at += size
    yield from merged(segments.values())


def index(spark, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Index entries of all archives under path, globally ordered by (url_key, timestamp, page) over the partitions."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = materialize(files.mapInArrow(_runs, _ENTRY + ", at long"), "capture-runs")
    keys = ["url_key", "timestamp", "page_id", "archive", "offset"]  # the last two part the captures of one page
    # range partitioning keeps a range's rows in one task; sorting by archive and place restores the runs' segments
    dealt = runs.repartitionByRange(1 + runs.count() // range_rows, *keys).withColumn("range", F.spark_partition_id())
    return dealt.sortWithinPartitions("range", "archive", "at").mapInArrow(_merge, _ENTRY)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives, read them back, and return the merged capture histories."""
    path = fresh(pages.sparkSession, "warc")
    write(pages, path)
    return index(pages.sparkSession, path)
