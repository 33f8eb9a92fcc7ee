"""Readers of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables; pruning and pushdown reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
