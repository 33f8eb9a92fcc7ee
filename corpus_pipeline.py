"""A corpus pipeline: each stage applies one operator to all that the one before kept.

The stages in order: the quality classifier drops what it rejects, exact and
near-duplicate groups keep one document each, documents that hold a benchmark
passage go, and what is left is encoded and decoded. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyworks.llm.bpe import digest_texts
from tallyworks.llm.common import durable, read_table
from tallyworks.llm.decontaminate import drop_contaminated
from tallyworks.llm.exact_dedup import drop_exact_copies
from tallyworks.llm.near_dedup import drop_near_copies
from tallyworks.llm.quality import keep_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_texts(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("bpe_round_trip", bpe_round_trip),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``; ``durable`` holds what each one kept."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs


#: The classifier, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None
