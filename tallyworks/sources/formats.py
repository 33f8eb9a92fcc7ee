"""File formats in and out: JSON, RSS, HTML and text; JSON lines, enveloped JSON and Markdown.

Rows that can't be read keep their text in ``_corrupt_record`` instead of
failing, so a bad file is a status and not an exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import FACT_SCHEMA

SUBMISSIONS = "cik STRING, filings STRUCT<recent: STRUCT<form: ARRAY<STRING>, filingDate: ARRAY<DATE>, accessionNumber: ARRAY<STRING>>>"
NEWS = "id LONG, headline STRING, summary STRING, source STRING, url STRING, datetime LONG, _corrupt_record STRING"
ITEM = "title STRING, link STRING, pubDate STRING, description STRING, category ARRAY<STRUCT<_VALUE: STRING, _domain: STRING>>, _corrupt_record STRING"


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """cik, form, filing_date and accession arrays of filing indexes."""
    rows = spark.read.schema(SUBMISSIONS).json(path)
    return rows.select("cik", F.col("filings.recent.form").alias("form"), F.col("filings.recent.filingDate").alias("filing_date"), F.col("filings.recent.accessionNumber").alias("accession"))


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACT_SCHEMA).json(path)


def read_news_json(spark: SparkSession, path: str) -> DataFrame:
    """News lists; a time over 10^10 is in milliseconds, else in seconds."""
    rows = spark.read.schema(NEWS).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    time = F.when(F.col("datetime") > 10_000_000_000, F.timestamp_millis("datetime")).otherwise(F.timestamp_seconds("datetime"))
    return rows.withColumn("published_at", time)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """The items of RSS feeds, with their time."""
    rows = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(ITEM).load(path)
    time = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, | GMT$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    return rows.withColumn("published_at", time)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """url (the file's path) and html of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def enveloped(rows: DataFrame, tool: str, as_of: str) -> DataFrame:
    """Each row as one JSON text with data, status and provenance."""
    meta = F.struct(F.lit(tool).alias("tool"), F.lit(as_of).alias("asOf"))
    return rows.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.struct("*").alias("data"), meta.alias("meta"))).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    """A table of one text column, such as Markdown or enveloped JSON."""
    rows.write.mode("overwrite").text(path)
