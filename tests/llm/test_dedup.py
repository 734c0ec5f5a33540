"""Exact deduplication and the n-gram join against brute force, and their edge cases."""

import hashlib
import random
import re

import pytest

from edgeloom.llm import components, exact_dedup, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_fingerprints_compose():
    rng = random.Random(1)
    for n in (0, 1, 8191, 8192, 8193, 40000):
        data = rng.randbytes(n)
        k = rng.randrange(n + 1)
        whole = exact_dedup.fingerprint(data)
        assert tuple(exact_dedup.combine(exact_dedup.fingerprint(data[:k]), exact_dedup.fingerprint(data[k:]), n - k)) == whole
    p, b = exact_dedup.PRIMES[0], exact_dedup.BASES[0]
    value = 0
    for x in b"some text":
        value = (value * b + x) % p
    assert exact_dedup.fingerprint(b"some text")[0] == value


def brute_dedup(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(doc, keep, len(members), doc == keep, hashlib.sha256(norm.encode()).hexdigest()) for doc, _ in members]
    return sorted(out, key=str)


CASES = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "é x"), (8, "éx"), (9, "A b"), (10, "x" * 30000), (11, "x" * 30000 + " "), (12, "x" * 29999), (1, "a b"), (None, "ab"), (14, "\x85ab"), (15, " ab")]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_dedup_cases(spark):
    docs = frame(spark, CASES)
    assert got(exact_dedup.exact_dedup(docs)) == brute_dedup(CASES)
    assert got(exact_dedup.exact_dedup(docs.where("false"))) == []
    kept = exact_dedup.keep(docs.withColumn("rep", docs.text).withColumn("xh", docs.doc_id))
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in CASES})
    assert kept.columns == ["doc_id", "text", "rep", "xh"]


def test_huge_texts_are_hashed_in_pieces(spark, monkeypatch):
    rows = [(1, "ab c" * 900), (2, "abc" * 900), (3, "abd" * 900), (4, "q")]
    docs = frame(spark, rows)
    whole = {r["doc_id"]: (r["hi"], r["lo"], r["n"]) for r in exact_dedup.fingerprints(docs).collect()}
    monkeypatch.setattr(exact_dedup, "HUGE_BYTES", 100)
    monkeypatch.setattr(exact_dedup, "BLOCK_BYTES", 64)
    assert exact_dedup.HUGE_BYTES == 100
    pieces = list(exact_dedup._scan(docs.select("doc_id", "text").toArrow().append_column("xh", __import__("pyarrow").array([1, 2, 3, 4])).to_batches()))
    total = {}
    for batch in pieces:
        hashed = next(exact_dedup._hash_pieces([batch])) if not all(batch.column("whole").to_pylist()) else batch
        for r, w in zip(hashed.to_pylist(), batch.to_pylist(), strict=True):
            part = [w[f"h{i}"] for i in range(1, 5)] if w["whole"] else [r[f"h{i}"] * r[f"s{i}"] for i in range(1, 5)] if r["body"] is None and not w["whole"] else None
            if part:
                total[r["doc_id"]] = [a + b for a, b in zip(total.get(r["doc_id"], [0] * 4), part, strict=True)]
    for doc in (1, 2, 3):
        h = [x % p for x, p in zip(total[doc], exact_dedup.PRIMES, strict=True)]
        assert (h[0] << 31 | h[1], h[2] << 31 | h[3]) == whole[doc][:2]


def test_repeated_huge_rows_all_stay(spark):
    """Rows beyond HUGE_BYTES with one doc_id, or none, and one text are rows of their own."""
    half = exact_dedup.HUGE_BYTES // 2 + 7
    rows = [(1, "ab", half), (1, "ab", half), (None, "ab", half), (None, "ab", half), (2, "a b", half), (3, "ac", half), (None, "ac", half), (4, "ab", 1), (4, "ab", 1)]
    docs = frame(spark, rows, "doc_id long, unit string, n int").selectExpr("doc_id", "repeat(unit, n) AS text").repartition(3)
    assert got(exact_dedup.exact_dedup(docs)) == brute_dedup([(d, t * n) for d, t, n in rows])


@pytest.mark.parametrize("heavy", [0, 4])
def test_equal_fingerprints_are_compared(spark, monkeypatch, heavy):
    """With one fingerprint for all, only the comparison tells texts apart, whether the group is whole in one task or dealt."""
    import pyspark.sql.functions as F

    def collide(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            fixed = [pa.array([x] * n, pa.int64()) for x in (5, 1, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("xh"), *fixed, b.column("at"), b.column("heavy"), b.column("text").cast(pa.binary())], ["doc_id", "xh", "n", "hi", "lo", "at", "heavy", "body"])

    rows = [(i, "abc"[i % 3] * 5) for i in range(12)] + [(None, "aaaaa"), (None, "bbbbb"), (3, "aaaaa")]
    docs = frame(spark, rows).repartition(3)
    prints = exact_dedup.fingerprints(docs)
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d: prints.withColumn("hi", F.lit(1)).withColumn("lo", F.lit(1)))
    monkeypatch.setattr(exact_dedup, "_bodies", collide)
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    assert got(exact_dedup.exact_dedup(docs)) == brute_dedup(rows)


def test_keep_leaves_own_columns_alone(spark):
    """Columns with the operators' own names come back as they were; repeated rows and null ids count once."""
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (None, "c"), (None, "c"), (3, None), (4, ""), (5, "d e f g h i"), (6, "D e f g h i")]
    names = ["_x", "_id", "_xh", "xh", "row", "named", "stays", "at", "_mark", "d", "x", "token", "g", "component_id"]
    docs = frame(spark, rows).select("doc_id", "text", *(frame_literal(n) for n in names))
    for f, want in ((exact_dedup.keep, {(1, "a b"), (None, "c"), (3, None), (5, "d e f g h i"), (6, "D e f g h i")}), (ngram_join.keep_one, {(1, "a b"), (2, "ab"), (None, "c"), (3, None), (4, ""), (5, "d e f g h i")})):
        kept = f(docs)
        assert kept.columns == docs.columns
        found = kept.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(want, key=str), f
        assert all(r[n] == n for r in found for n in names)


def frame_literal(name):
    import pyspark.sql.functions as F

    return F.lit(name).alias(name)


def shingle_set(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(doc, shingle_set(t)) for doc, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        a = sets[i][1]
        for j in range(i):
            b = sets[j][1]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least.get(find(i))) for i, (doc, s) in enumerate(sets))


def test_ngram_join_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = sorted(tuple(r) for r in ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert found == brute_components([tuple(r) for r in docs.collect()])


def variants(rng, n):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(words[: rng.randrange(50, 61)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_chains(spark, seed):
    """Many near copies, some linked only through others."""
    rng = random.Random(seed)
    rows = variants(rng, 120) + [(1000 + i, t) for i, (_, t) in enumerate(variants(rng, 5))] + [(2000, ""), (2001, None), (2002, " "), (2003, "a b"), (2004, "A\tB"), (2005, "a b c"), (2003, "a b")]
    found = sorted(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())
    assert found == brute_components(rows)
    kept = ngram_join.keep_one(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in brute_components(rows)})


def test_small_steps_write_few_files(spark):
    """A step whose few rows are dealt over many partitions writes some files a core, not one per partition, and loses nothing."""
    from pathlib import Path

    from edgeloom.llm.common import scratch

    rows = variants(random.Random(7), 150) + [(1000 + i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(150)]
    root = Path(scratch(spark).removeprefix("file://"))
    before, conf = set(root.glob("*")), {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = sorted(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == brute_components(rows)
    files = {d.name.rsplit("-", 1)[0]: len(list(d.glob("part-*"))) for d in set(root.glob("*")) - before}
    # the index has as many rows as its sets' prefixes; its parts are those of its shuffle
    steps = {k: n for k, n in files.items() if k != "lists"}
    assert {"class-sizes", "groups", "entries", "group-sizes", "candidates", "similar", "open-lists"} <= set(steps)
    assert max(steps.values()) <= 2 * spark.sparkContext.defaultParallelism, steps


def test_ngram_join_empty(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


def test_long_texts_hash_alike(monkeypatch):
    text = " ".join(f"word{i}" for i in range(2000)).encode()
    whole = ngram_join.shingles(text)
    monkeypatch.setattr(ngram_join, "SEGMENT", 100)
    assert (ngram_join.shingles(text) == whole).all()
    assert len(whole) == 1996


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert {r["node"]: r["root"] for r in components.components(frame(spark, edges, "a long, b long")).collect()} == want


def test_parity_bits_bound_the_difference_of_sets():
    import numpy as np

    from edgeloom.llm.ngram_join import parity_bits

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for _ in range(200):
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        bits = (int.from_bytes(parity_bits(x)) ^ int.from_bytes(parity_bits(y))).bit_count()
        assert bits <= len(np.setxor1d(x, y))
