"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical without white space. Lengths that occur
once are out after the first step, and prefixes that occur once after the
second; only what is left is hashed whole and grouped. The two sets of
surviving keys are Bloom filters of bounded size, and the full hash decides, so
no group is ever gathered and no text is shuffled.

Results by case: a null text counts as empty, so null, empty and blank texts
are equal. Of equal texts the longest original stays, then the smallest doc_id;
a null doc_id comes after all others. Rows that repeat both doc_id and text are
one document: in the digest they stay or go together, and dropping copies leaves
one of them. Only doc_id and text are read, so other
columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import ask_bloom, blocked_bloom, keep_rows, row_keys
from .common import durable

#: Code points of the normalised text that the second step hashes.
PREFIX = 64
#: The white space that is deleted, \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _refined(docs: DataFrame, hash_all: bool = False, keyed: bool = False) -> DataFrame:
    """doc_id, n_original, maybe (false: no other row is equal) and digest of each row, and k1 and k2 if ``keyed`` asks for them."""
    keys = row_keys() if keyed else ()
    text = docs.select("doc_id", *keys, F.length(F.coalesce("text", F.lit(""))).alias("n_original"), normalised(F.col("text")).alias("body"))
    n, prefix = F.length("body"), F.left("body", F.lit(PREFIX))
    light = durable(text.select(F.xxhash64(n).alias("by_length"), F.xxhash64(n, prefix).alias("by_prefix")))

    def repeated(rows: DataFrame, key: str) -> DataFrame:
        return blocked_bloom(rows.groupBy(key).count().where("count > 1"), key)

    left_over = ask_bloom(light, "by_length", repeated(light, "by_length"), "maybe").where("maybe")
    twice = repeated(left_over, "by_prefix")
    asked = ask_bloom(text.withColumn("by_prefix", F.xxhash64(n, prefix)), "by_prefix", twice, "maybe")
    full = F.unhex(F.sha2("body", 256))
    names = ["doc_id", "n_original", "maybe"] + (["k1", "k2"] if keyed else [])
    return durable(asked.select(*names, (full if hash_all else F.when(F.col("maybe"), full)).alias("digest")))


def exact_groups(docs: DataFrame, hash_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest (binary SHA-256) of each row.

    The digest is null for rows that the first two steps decided, unless
    ``hash_all`` asks for it.
    """
    rows = _refined(docs, hash_all)
    best = F.min(F.struct(-F.col("n_original"), F.col("doc_id").isNull(), F.col("doc_id"))).getField("doc_id")
    groups = rows.where("maybe").groupBy("digest").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    # a second key makes both sides shuffle, so that a text with very many copies can be split
    spare = F.xxhash64("digest").alias("spare")
    joined = rows.where("maybe").select("*", spare).join(groups.select("*", spare), ["digest", "spare"])
    found = joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    single = rows.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return found.unionByName(single)


def exact_digest(docs: DataFrame) -> DataFrame:
    """One row per document with the SHA-256 of its normalised text."""
    return exact_groups(docs, hash_all=True).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """The doc_id of every document that gives way to an equal one."""
    return exact_groups(docs).where("not kept").select("doc_id")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, in the columns of ``docs``; of rows that repeat doc_id and text, one too."""
    rows = _refined(docs, keyed=True).where("maybe")
    best = F.min(F.struct(-F.col("n_original"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("k1"), F.col("k2"))).alias("best")
    groups = rows.groupBy("digest").agg(best, F.count("*").alias("group_size")).where("group_size > 1").select("digest", F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2"))
    # a second key makes both sides shuffle, so that a text with very many copies can be split
    spare = F.xxhash64("digest").alias("spare")
    joined = rows.select("digest", "k1", "k2", spare).join(groups.select("*", spare), ["digest", "spare"])
    return keep_rows(docs, durable(joined.select("k1", "k2", F.expr("k1 = b1 and k2 = b2").alias("stays"))))


EXACT_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
