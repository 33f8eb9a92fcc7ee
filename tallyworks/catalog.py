"""The market queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analyst, companies, documents, events, evidence, facts, filings, fundamentals, funds, options, releases, streams, technicals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (technicals, fundamentals, options, analyst, events, evidence, facts, documents, filings, funds, companies, releases, streams):
    QUERIES |= module.GROUP.queries
    ORACLE_SQL |= module.GROUP.oracle_sql
