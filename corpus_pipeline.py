"""The corpus pipeline: each stage reads all that its predecessor kept and writes what stays, as Parquet.

toxicity -> exact dedup -> n-gram Jaccard join -> benchmark decontamination -> packing

Defined results: null ids and texts, blanks and extra columns go through the filters as they are; columns and types stay. An
empty table stays empty. Of repeated rows one stays from exact_dedup on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from edgeloom.llm.common import materialize, table
from edgeloom.llm.queries import byte_bpe, learning_labels


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; a null or blank text has the score of a text without insults and stays. The grammar is learned from the given tables' labels, not from `docs`."""
    grammar = toxicity.train(table(spark, sf_dir, "documents"), learning_labels(spark, sf_dir))
    return toxicity.reject_toxic(docs, grammar)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest original, then the smallest id (null last). Null, empty and
    blank texts are one group."""
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: that of the smallest id (null last). Texts without words stay."""
    return ngram_join.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark passages are cut from the others, and n_chars follows. Null texts stay null."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; a null or empty text is its end id alone."""
    return packing.pack(docs, byte_bpe())


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("ngram_join", near), ("decontamination", leaks), ("packing", sequences)]

#: Clause grammars, components and tokens have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
