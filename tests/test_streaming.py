"""Streaming forms against their batch results."""

import os

import pytest
from pyspark.sql import functions as F

from tallyworks.streaming import windows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_repeats(spark, tmp_path):
    got = windows.run_available(windows.without_repeats(windows.event_stream(spark, SF), ["user_id", "event_type"]), str(tmp_path / "a"))
    batch = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct()
    assert got.select("user_id", "event_type").distinct().count() == batch.count()


def test_windows(spark, tmp_path):
    got = windows.run_available(windows.tumbling_counts(windows.event_stream(spark, SF), "1 day"), str(tmp_path / "b"), "complete")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.to_date("ts").alias("d"), "event_type").count()
    assert {(r["start"].date(), r["event_type"]): r["n"] for r in got.collect()} == {(r["d"], r["event_type"]): r["count"] for r in batch.collect()}


def test_flow(spark, tmp_path):
    got = windows.run_available(windows.flow_state(windows.event_stream(spark, SF)), str(tmp_path / "c"))
    rows = got.collect()
    want = {r["user_id"]: r["v"] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.sum("value").alias("v")).collect()}
    assert {r["user_id"]: pytest.approx(r["volume"]) for r in rows} == want


def test_sessions(spark, tmp_path):
    got = windows.run_available(windows.sessions(windows.event_stream(spark, SF)), str(tmp_path / "d"), "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
