"""Parts of long filings: mentions of a topic, commentary, numbers of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def topic_mentions(sections: DataFrame, terms: list[str]) -> DataFrame:
    """For each (doc_id, term) the sections whose text contains the term, in any case, and how often."""
    plain = F.lower("text")
    counts = F.array(*[F.struct(F.lit(t).alias("term"), (F.size(F.split(plain, rf"\Q{t.lower()}\E")) - 1).cast("long").alias("n")) for t in terms])
    rows = sections.select("doc_id", "section", F.explode(counts).alias("c")).where("c.n > 0")
    return rows.groupBy("doc_id", F.col("c.term").alias("term")).agg(F.count("*").alias("n_sections"), F.sum("c.n").alias("n_mentions"), F.min("section").alias("first_section"))


def commentary(texts: DataFrame, topics: list[str]) -> DataFrame:
    """The first sentence about each topic, or NOT_FOUND."""
    sentences = F.split("text", r"(?<=[.!?])\s+")
    rows = texts.select("doc_id", sentences.alias("sentences"), F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"))
    first = F.get(F.filter("sentences", lambda s: F.contains(F.lower(s), F.lower(F.col("topic")))), 0)
    return rows.select("doc_id", "topic", first.alias("summary"), F.when(first.isNull(), "NOT_FOUND").otherwise("FOUND").alias("status"))


def cell_number(cell: Column) -> Column:
    """The number of a cell, or null: brackets are a minus sign, K, M and B are factors, and a percent sign is left out."""
    plain = F.upper(F.regexp_replace(cell, r"[$,%\s]", ""))
    signed = F.regexp_replace(plain, r"^\((.*)\)$", "-$1")
    number, suffix = (F.regexp_extract(signed, r"^(-?[0-9]*[.]?[0-9]+[.]?)([KMB]?)$", i) for i in (1, 2))
    factor = F.when(suffix == "B", 1e9).when(suffix == "M", 1e6).when(suffix == "K", 1e3).otherwise(1.0)
    return F.when(number != "", number.try_cast("double") * factor)
