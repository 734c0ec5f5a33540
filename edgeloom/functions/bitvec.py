"""Bit vectors as 64-bit words: (key..., word, bits)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_of(i, offset=0):
    return F.floor((i - offset) / 64).cast("long")


def bit_of(i, offset=0):
    return F.pmod(i - offset, F.lit(64)).cast("int")


def build(df: DataFrame, keys: list[str], index: str, offset: int = 0) -> DataFrame:
    """Set a bit for each row."""
    i = F.col(index)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit_of(i, offset))
    return df.groupBy(*keys, word_of(i, offset).alias("word")).agg(F.bit_or(one).alias("bits"))


def get(bits, i, offset=0):
    """0 or 1: the bit of index i in its word."""
    return F.getbit(bits, bit_of(i, offset))


def clear(vectors: DataFrame, first: int, last: int, offset: int = 0) -> DataFrame:
    """Clear the bits of indexes first..last, inclusive and exact; empty words go."""
    low, high = F.lit(first - offset) - F.col("word") * 64, F.lit(last - offset) - F.col("word") * 64
    span = lambda n: F.when(n <= 0, F.lit(0).cast("long")).when(n >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1)
    gone = span(high + 1).bitwiseAND(F.bitwise_not(span(low)))
    gone = F.when((high < 0) | (low > 63), F.lit(0).cast("long")).otherwise(gone)
    return vectors.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(gone))).where("bits <> 0")


def count_and(left, right):
    """Number of bits that two words share."""
    return F.bit_count(left.bitwiseAND(right)).cast("long")


def extent(vectors: DataFrame, keys: list[str], offset: int = 0) -> DataFrame:
    """key..., size (bits of the words from the offset to the last one), end_idx (the index behind them), bits (that are set)."""
    words = (F.max("word") + 1) * 64
    return vectors.groupBy(*keys).agg(words.alias("size"), (words + offset).alias("end_idx"), F.sum(F.bit_count("bits")).cast("long").alias("bits"))
