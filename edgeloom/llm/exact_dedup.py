"""Exact deduplication by composable polynomial fingerprints.

A text is normalised (white space deleted) and hashed chunk by chunk as a polynomial over four prime fields. Chunk hashes
combine by length-shifted arithmetic, hash(A + B) = hash(A) * base^len(B) + hash(B), so the pieces of a huge document are
hashed on different workers and summed by an ordinary aggregate. Equal fingerprints are only candidates: their texts are
then compared chunk by chunk in a stream, first inside a partition, then between the partitions' representatives.

Defined results: a null text counts as empty, and all empty texts are equal. Rows that share doc_id and text are repeated
rows; each gets the same verdict here, and ``keep`` retains one of them. A null doc_id stays null and loses ties. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, materialize, ship, without_redundant

#: The four largest primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525017, 214013091, 1597463007)
CHUNK = 8192  # 256 * 2^31 * 8192 = 2^52: a chunk's dot product is exact in float64
HUGE_BYTES = 8 << 20  # texts beyond this are hashed piecewise on several workers
BLOCK_BYTES = 1 << 20  # size of those pieces, and of the blocks that are compared
SALTS = 32  # tasks that share the small rows of one group
HEAVY = 4  # rows a partition beyond which a group of equal fingerprints is dealt to all partitions
WHITE = b" \t\n\x0b\x0c\r"

_powers: list[np.ndarray] = []


def _weights() -> np.ndarray:
    if not _powers:
        columns = []
        for p, b in zip(PRIMES, BASES, strict=True):
            w = [1] * CHUNK
            for i in range(CHUNK - 2, -1, -1):
                w[i] = w[i + 1] * b % p
            columns.append(w)
        _powers.append(np.array(columns, dtype=np.float64).T.copy())
    return _powers[0]


def fingerprint(data: bytes) -> tuple[int, ...]:
    """The hash of data in each field."""
    weights, total = _weights(), [0] * len(PRIMES)
    full = len(data) // CHUNK
    values = np.frombuffer(data, np.uint8)
    rows = []
    for at in range(0, full, 256):
        n = min(256, full - at)
        rows += (values[at * CHUNK : (at + n) * CHUNK].reshape(n, CHUNK).astype(np.float64) @ weights).astype(np.int64).tolist()
    for row in rows:
        total = combine(total, row, CHUNK)
    if rest := len(data) - full * CHUNK:
        row = (values[full * CHUNK :].astype(np.float64) @ weights[CHUNK - rest :]).astype(np.int64).tolist()
        total = combine(total, row, rest)
    return tuple(total)


def combine(left, right, right_length: int) -> list[int]:
    """The hash of a concatenation from the hashes of its halves."""
    return [(a * pow(b, right_length, p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES, strict=True)]


_SCAN = "row long, doc_id long, xh long, pts long, sha string, n long, whole boolean, seq int, h1 long, h2 long, h3 long, h4 long, s1 long, s2 long, s3 long, s4 long, body binary"
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("xh", pa.int64()), ("pts", pa.int64()), ("sha", pa.string()), ("n", pa.int64()), ("whole", pa.bool_()), ("seq", pa.int32()), *((f"{c}{i}", pa.int64()) for c in "hs" for i in range(1, 5)), ("body", pa.binary())])


def _texts(batch):
    return batch.column("text").cast(pa.binary()).to_pylist()


def _scan(batches):
    """Each row gets a number of its own, by task and place; it is written with the row's pieces."""
    from pyspark import TaskContext

    task = TaskContext.get()
    number = itertools.count(task.partitionId() << 33 if task else 0)
    for batch in batches:
        rows = []
        for doc, xh, raw in zip(batch.column("doc_id").to_pylist(), batch.column("xh").to_pylist(), _texts(batch), strict=True):
            raw = raw or b""
            norm = raw.translate(None, WHITE)
            points = len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))
            head = (next(number), doc, xh, points, hashlib.sha256(norm).hexdigest(), len(norm))
            if len(norm) <= HUGE_BYTES:
                rows.append((*head, True, 0, *fingerprint(norm), 1, 1, 1, 1, None))
                continue
            for seq, at in enumerate(range(0, len(norm), BLOCK_BYTES)):
                piece = norm[at : at + BLOCK_BYTES]
                shift = (pow(b, len(norm) - at - len(piece), p) for b, p in zip(BASES, PRIMES, strict=True))
                rows.append((*head, False, seq, 0, 0, 0, 0, *shift, piece))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


def _hash_pieces(batches):
    for batch in batches:
        hashes = list(zip(*map(fingerprint, batch.column("body").to_pylist()), strict=True)) or [()] * 4
        columns = {f.name: batch.column(f.name) for f in _ARROW}
        columns |= {f"h{i + 1}": pa.array(h, pa.int64()) for i, h in enumerate(hashes)}
        columns["body"] = pa.nulls(batch.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns.values()), schema=_ARROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, xh (hash of the raw text, tells rows with one doc_id apart), pts, sha, n, hi, lo for every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("xh"))
    scanned = materialize(rows.mapInArrow(_scan, _SCAN), "fingerprint-pieces")
    keys = ["doc_id", "xh", "pts", "sha", "n"]
    packed = lambda a, b: F.shiftleft(F.col(a), 31).bitwiseOR(F.col(b))
    whole = scanned.where("whole").select(*keys, packed("h1", "h2").alias("hi"), packed("h3", "h4").alias("lo"))
    pieces = scanned.where("not whole").repartition(F.xxhash64("row", "seq")).mapInArrow(_hash_pieces, _SCAN)
    summed = pieces.groupBy("row", *keys).agg(*(F.pmod(F.sum(F.pmod(F.col(f"h{i}") * F.col(f"s{i}"), F.lit(p))), F.lit(p)).alias(f"h{i}") for i, p in enumerate(PRIMES, 1)))
    return whole.unionByName(summed.select(*keys, packed("h1", "h2").alias("hi"), packed("h3", "h4").alias("lo")))


_BODIES = "doc_id long, xh long, n long, hi long, lo long, at long, heavy boolean, body binary"
_MEMBERS = "doc_id long, xh long, n long, hi long, lo long, rep string, mark string, block int, body binary"


def _bodies(batches):
    for batch in batches:
        rows = []
        for doc, xh, at, heavy, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "xh", "at", "heavy")), _texts(batch), strict=True):
            norm = (raw or b"").translate(None, WHITE)
            a, b, c, d = fingerprint(norm)
            rows.append((doc, xh, len(norm), a << 31 | b, c << 31 | d, at, heavy, norm))
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _BODIES.split(", ")])


def same(left: bytes, right: bytes) -> bool:
    """Blockwise comparison that stops at the first difference."""
    a, b = memoryview(left), memoryview(right)
    return len(a) == len(b) and all(a[i : i + BLOCK_BYTES] == b[i : i + BLOCK_BYTES] for i in range(0, len(a), BLOCK_BYTES))


def _compare_local(batches):
    """Rows arrive sorted by fingerprint. A group that is here whole gets its marks at once: the number of each row's text among
    the group's, from the second on. Of a heavy group each row points to its partition's representative with the same text,
    and only the representatives' blocks travel on."""
    from pyspark import TaskContext

    task, made, key, reps = TaskContext.get().partitionId(), 0, None, []
    names = [x.split()[0] for x in _MEMBERS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int32(), pa.binary()]
    for batch in batches:
        rows = []
        bodies, heavy = batch.column("body"), batch.column("heavy").to_pylist()
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names[:5]), strict=True)):
            if row[2:] != key:
                key, reps = row[2:], []
            body = bodies[i].as_py()
            at = next((j for j, (_, b) in enumerate(reps) if same(b, body)), len(reps))
            if at == len(reps):
                reps.append((f"{task}:{made}", body))
                made += 1
                if heavy[i]:
                    rows += [(*row, reps[at][0], None, k, body[x : x + BLOCK_BYTES]) for k, x in enumerate(range(0, len(body), BLOCK_BYTES))]
            if heavy[i] or at:
                rows.append((*row, reps[at][0] if heavy[i] else None, None if heavy[i] else str(at), None, None))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _compare_blocks(batches):
    """Blocks arrive sorted by fingerprint, block number and representative; those that differ from the first are told."""
    key, seen = None, []
    for batch in batches:
        out = []
        for n, hi, lo, block, rep, body in zip(*(batch.column(c).to_pylist() for c in ("n", "hi", "lo", "block", "rep", "body")), strict=True):
            if (n, hi, lo, block) != key:
                key, seen = (n, hi, lo, block), []
            kind = next((k for k, b in enumerate(seen) if b == body), len(seen))
            if kind == len(seen):
                seen.append(body)
            if kind:
                out.append((rep, f"{block}:{kind}"))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["rep", "mark"])


def _odd_rows(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """doc_id, xh, mark of the rows whose fingerprint equals that of a different text (none is expected).

    Only texts of repeated fingerprints leave the scan (``among``). A group goes to one task, where its first text is
    compared with the others; one of more than HEAVY rows a partition goes to all, and the partitions' representatives are
    compared block by block."""
    keys, parts = ["n", "hi", "lo"], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = prints.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id", "xh"), F.lit(SALTS)).cast("int"))
    chosen = salted.join(repeated, [*keys, "salt"]).select("doc_id", "xh", (F.col("c") > HEAVY * parts).alias("heavy"))
    chosen = materialize(chosen.distinct(), "repeated-rows")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("xh"), F.monotonically_increasing_id().alias("at"))
    named = among(rows, chosen, "named").where("named").drop("named")
    bodies = among(named, chosen.where("heavy"), "heavy").select("doc_id", "xh", "at", "heavy", "text").mapInArrow(_bodies, _BODIES)
    dealt = bodies.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("at"), F.lit(parts))).otherwise(0))
    dealt = dealt.repartition(*keys, "salt").sortWithinPartitions(*keys, "doc_id", "xh")
    compared = materialize(dealt.mapInArrow(_compare_local, _MEMBERS), "compared")
    blocks = compared.where("block is not null").repartition(*keys, "block").sortWithinPartitions(*keys, "block", "rep")
    odd = blocks.mapInArrow(_compare_blocks, "rep string, mark string").groupBy("rep").agg(F.concat_ws(",", F.sort_array(F.collect_list("mark"))).alias("mark"))
    far = compared.where("block is null and rep is not null").select("doc_id", "xh", "rep").join(materialize(odd, "odd-blocks"), "rep").select("doc_id", "xh", "mark")
    return materialize(far.unionByName(compared.where("mark is not null").select("doc_id", "xh", "mark")).distinct(), "odd-rows")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, xh, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text stays, then the one with the smallest doc_id.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    odd = _odd_rows(docs, prints)
    marked = prints
    if odd.limit(1).count():
        marked = prints.join(odd.withColumnRenamed("doc_id", "d").withColumnRenamed("xh", "x"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xh") == F.col("x")), "left").drop("d", "x")
    else:
        marked = prints.withColumn("mark", F.lit(None).cast("string"))
    marked = marked.withColumn("mark", F.coalesce("mark", F.lit("")))
    keys = ["n", "hi", "lo", "mark"]
    groups = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct(F.col("pts"), (-F.col("doc_id")).alias("neg"))).alias("best")).where("group_size > 1")
    groups = groups.select(*keys, "group_size", (-F.col("best.neg")).alias("keep_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "xh"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, [*keys, "salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", "xh", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def keep(docs: DataFrame) -> DataFrame:
    """docs without the rows that an equal text makes redundant; repeated rows count once. Only rows of groups are shuffled."""
    return without_redundant(docs, exact_dedup(docs).where("group_size > 1").select("doc_id", "xh", F.col("kept").alias("stays")))
