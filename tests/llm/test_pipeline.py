"""The corpus pipeline against brute force, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.llm import packing, queries, toxicity

from .test_dedup import brute_components, brute_dedup
from .test_tokens import brute, check, library_ids


def test_stages(spark, small_dir):
    docs = queries.table(spark, small_dir, "documents").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "packing"]
    g = toxicity.train(docs, queries.learning_labels(spark, small_dir))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {d for d, t in rows.items() if g.score(t or "") < 0.7}
    now = stages["toxicity"](spark, docs, small_dir)
    assert {r["doc_id"] for r in now.collect()} == want
    now = stages["exact_dedup"](spark, docs, small_dir)
    want = {r[0] for r in brute_dedup(list(rows.items())) if r[3]}
    assert sorted(r["doc_id"] for r in now.collect()) == sorted(want)
    now = stages["ngram_join"](spark, docs, small_dir)
    want = {c for _, _, c in brute_components(list(rows.items()))}
    assert sorted(r["doc_id"] for r in now.collect()) == sorted(want)
    assert now.columns == docs.columns
    now = stages["decontamination"](spark, docs, small_dir)
    items = [tuple(r) for r in queries.table(spark, small_dir, "benchmark").collect()]
    verdict = brute(list(rows.items()), items)
    left = {r["doc_id"]: r["text"] for r in now.collect()}
    assert left.keys() == {r[0] for r in verdict if not r[5]}
    assert all((left[r[0]] == rows[r[0]]) == (r[2] == 0) for r in verdict if r[0] in left)
    assert now.dtypes == docs.dtypes


def test_run(spark, small_dir):
    """The last stage packs exactly what the four before it keep."""
    out = corpus_pipeline.run(spark, small_dir)
    assert out.columns == packing.pack(queries.table(spark, small_dir, "documents"), queries.byte_bpe()).columns
    docs = queries.table(spark, small_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small_dir).cache()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check([r.asDict() for r in out.collect()], dict(zip(kept, library_ids(kept.values()), strict=True))) < 0.02 and len(kept) > 100


def test_stages_on_odd_rows(spark, small_dir):
    """Null ids and texts, blanks, repeated rows, a very long text, clashing columns: every stage keeps types and clean rows."""
    long_text = " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, "only one of these stays here now", "x"), (None, "only one of these stays here now", "x"), (1, None, None), (2, "", "y"), (3, " \n", "z"), (4, long_text, "z"), (5, long_text + " end", "z"), (6, "a b", "q"), (6, "a b", "q"), (7, "you idiot. you moron. you scum. you idiot.", "t")]
    names = ["row", "xh", "named", "g", "score", "items", "hit"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), *(F.lit(n).alias(n) for n in names))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, small_dir).cache()
        assert now.dtypes == docs.dtypes, name
        assert stage(spark, docs.where("false"), small_dir).count() == 0
    got = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in now.collect()), key=str)
    assert got == sorted([(None, "only one "), (3, " \n"), (4, "w0 w1 w2 "), (6, "a b")], key=str)
    assert all(r[n] == n for r in now.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, now, small_dir).count() > 4
