"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, licenses, ngram_join, packing, pii, secrets, sharding, toxicity, warc
from .common import table

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def learning_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from: rows whose crc32(doc_id as text) mod 3 is not 1."""
    return table(spark, sf_dir, "labels").where("crc32(cast(doc_id as string)) % 3 <> 1")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.train(docs, learning_labels(spark, sf_dir)))
    return scores.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 3 = 1").alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("xh")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_join": op4_ngram_join,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_secret_scan": op10_secret_scan,
}

SQL = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END AS k FROM (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
pos AS (SELECT doc_id, w, k, unnest(range(1, CASE WHEN len(w) >= k THEN len(w) - k + 2 ELSE 1 END)) AS i FROM d, (SELECT DISTINCT k FROM b)),
hits AS (SELECT p.doc_id, p.i, p.k, win.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM pos) p JOIN win ON p.s = win.s AND p.k = win.k),
n_hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS pts, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY pts DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k""",
    "op3_license_scan": licenses.scan_sql(),
    "op5_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN m <> page_id THEN m END AS refers_to FROM p LEFT JOIN g ON p.h = g.h AND n >= 1000""",
    "op7_sharding": """
WITH k AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT d, h >> (60 - d) AS p, sum(bytes) AS b, count(*) AS n FROM k, range(0, 25) AS r(d) GROUP BY d, h >> (60 - d)),
leaf AS (SELECT c.d, c.p FROM s c LEFT JOIN s u ON u.d = c.d - 1 AND u.p = c.p >> 1 WHERE c.b <= 67108864 AND (c.d = 0 OR u.b > 67108864))
SELECT doc_id, bytes, CAST(d AS BIGINT) AS depth, p AS prefix, CAST(0 AS BIGINT) AS page FROM k JOIN leaf ON h >> (60 - d) = p""",
}
