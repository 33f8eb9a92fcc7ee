"""Streaming forms: de-duplication under a watermark, session windows and keyed flow state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATENESS = "3 days"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source reads folders: a table that is one file is named by a pattern
    stream = spark.readStream.schema(schema).parquet(f"{path}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time with a zone


def without_repeats(stream: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """The first event of each key; keys are forgotten once the watermark has passed."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(stream: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Events and the sum of their values for each type and window."""
    cents = F.sum(F.expr("CAST(round(value * 100) AS BIGINT)"))
    rows = stream.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), cents.alias("cents"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Runs of a user's events with no longer gap between them."""
    rows = stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


STATE = "volume double, readings long"
FLOW = "user_id long, readings long, volume double, before double, trend string"


def _flow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    before, readings = state.get if state.exists else (None, 0)
    volume, newest = 0.0, 0
    for batch in batches:
        volume += float(batch["value"].sum())
        newest = max(newest, int(batch["ts"].max().timestamp() * 1000))
    trend = None if not before else "INCREASING" if volume / before > 1.1 else "DECREASING" if volume / before < 0.9 else "STABLE"
    state.update((volume, readings + 1))
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1) + 72 * 3600 * 1000)
    yield pd.DataFrame({"user_id": [key[0]], "readings": [readings + 1], "volume": [volume], "before": [before], "trend": [trend]})


def flow_state(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """A user's volume of each batch against the batch before, kept for 72 hours of event time."""
    return stream.withWatermark("ts", lateness).groupBy("user_id").applyInPandasWithState(_flow, FLOW, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what there is, and read back the rows that were written below ``folder``; its checkpoint is there too."""
    rows = f"{folder}/rows"
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(rows)
    write = "overwrite" if mode == "complete" else "append"
    query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode(write).parquet(rows)).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)
