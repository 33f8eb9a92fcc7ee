"""A blocked Bloom filter made and asked with DataFrame operations only.

A key's hash names one block of 64 bits and four bits in it. The blocks that
have any bit set form a table of at most ``n_blocks`` rows, which bounds what
is broadcast however many keys are listed; a filter that fills up lets more
keys pass, and an exact step behind it decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 MB of bits: 1 % false hits for about 1.3 million keys.
BLOCKS = 1 << 18
BITS_OF_KEY = 4


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 24), F.lit(n_blocks)).cast("int")


def _mask(key: Column) -> Column:
    places = (F.shiftrightunsigned(key, 6 * i).bitwiseAND(63).cast("int") for i in range(BITS_OF_KEY))
    bits = (F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places)
    return reduce(Column.bitwiseOR, bits)


def blocked_bloom(keys: DataFrame, key: str, n_blocks: int = BLOCKS) -> DataFrame:
    """The filter of a long column of hashes: one row for each block with a bit set."""
    k = F.col(key)
    return keys.select(_block(k, n_blocks).alias("bloom_block"), _mask(k).alias("mask")).groupBy("bloom_block").agg(F.bit_or("mask").alias("bloom_bits"))


def ask_bloom(df: DataFrame, key: str, bloom: DataFrame, flag: str, n_blocks: int = BLOCKS) -> DataFrame:
    """``df`` with a boolean column that is false only where the key is certainly not listed."""
    k = F.col(key)
    asked = df.withColumn("bloom_asked", _block(k, n_blocks)).join(F.broadcast(bloom), F.col("bloom_asked") == F.col("bloom_block"), "left")
    hit = F.coalesce(F.col("bloom_bits").bitwiseAND(_mask(k)) == _mask(k), F.lit(False))
    return asked.withColumn(flag, hit).drop("bloom_asked", "bloom_block", "bloom_bits")


def row_keys() -> tuple[Column, Column]:
    """Two hashes with different seeds: 128 bits that stand for a row's doc_id and text."""
    return tuple(F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")).alias(k) for seed, k in enumerate(("k1", "k2")))


def keep_rows(docs: DataFrame, told: DataFrame, once: bool = True) -> DataFrame:
    """The rows of ``docs`` but those that ``told`` (k1, k2, stays) drops, in the columns of ``docs``.

    Of the rows that repeat a doc_id and text that ``told`` lists as staying,
    one is kept if ``once`` is set. Rows that the filter clears never move.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *row_keys())
    asked = ask_bloom(packed, "k1", blocked_bloom(told, "k1"), "maybe")
    hits = asked.where("maybe").select("k1", "k2", "row")
    if once:
        hits = hits.groupBy("k1", "k2").agg(F.min_by("row", F.to_json("row")).alias("row"))
    left = hits.join(told.where("not stays").select("k1", "k2").distinct(), ["k1", "k2"], "left_anti")
    return asked.where("not maybe").select("row.*").unionByName(left.select("row.*"))
