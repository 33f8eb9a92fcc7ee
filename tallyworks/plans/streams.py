"""Queries that run streams over the tables: paged pulls and keyed readings over several batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources.tables import read_table
from ..streaming import pages as P
from ..streaming import readings as R
from .registry import Group

GROUP = Group()
query = GROUP.query

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Numbers of items that a page spans, and batches of a stream.
PAGE, BATCHES = 500, 4


def new_folder(spark, name: str) -> str:
    """A folder of this run where the cluster keeps checkpoints; a temporary one only where there is none and the master is local."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir: a folder that all executors share is needed on a cluster")
    return f"{shared}/{name}-{uuid.uuid4()}" if shared else tempfile.mkdtemp(prefix=name)


@query("SELECT event_type AS feed, event_id, user_id FROM events")
def paged_pull(spark, sf_dir):
    """The events as paged feeds by type, pulled, stopped and pulled again."""
    folder = new_folder(spark, "paged_pull")
    events = read_table(spark, sf_dir, "events")
    items = events.select(F.col("event_type").alias("feed"), F.floor(F.col("event_id") / PAGE).alias("page"), F.struct("event_id", "user_id").alias("item"))
    P.write_pages(items, f"{folder}/feeds")
    for _ in range(2):
        rows = P.pull(P.feed_stream(spark, f"{folder}/feeds"), folder)
    item = F.from_json("item", "event_id long, user_id long")
    return rows.select("feed", item.alias("item")).select("feed", "item.*")


@query("""
WITH r AS (
    SELECT 'U' || user_id AS ticker, event_id AS reading_id, ['T-14', 'T-7', 'T-2'][event_id % 3 + 1] AS label, ts, epoch_ms(ts) AS ms,
           CASE WHEN event_id % 5 <> 0 THEN value WHEN event_id % 11 <> 0 THEN CAST(event_id % 7 AS DOUBLE) END AS measure FROM events),
b AS (
    SELECT *, CASE label WHEN 'T-7' THEN last_value(CASE WHEN label = 'T-14' THEN {'ms': ms, 'id': reading_id, 'measure': measure} END IGNORE NULLS) OVER w
                         WHEN 'T-2' THEN last_value(CASE WHEN label = 'T-7' THEN {'ms': ms, 'id': reading_id, 'measure': measure} END IGNORE NULLS) OVER w END AS f
    FROM r WINDOW w AS (PARTITION BY ticker ORDER BY ts, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT ticker, reading_id, label, measure, CASE WHEN ms - f.ms <= 259200000 THEN f.id END AS before_id, CASE WHEN ms - f.ms <= 259200000 THEN f.measure END AS "before" FROM b)
SELECT *, CASE WHEN "before" > 0 AND measure / "before" > 1.1e0 THEN 'INCREASING' WHEN "before" > 0 AND measure / "before" < 0.9e0 THEN 'DECREASING' ELSE 'STABLE' END AS trend FROM k""")
def flow_readings(spark, sf_dir):
    """Readings of each user in several batches by time, in one continued query."""
    folder = new_folder(spark, "flow_readings")
    k = F.col("event_id")
    labels = F.element_at(F.array(*[F.lit(x) for x in ("T-14", "T-7", "T-2")]), (k % 3 + 1).cast("int"))
    ts = F.col("ts").cast("timestamp")
    readings = read_table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), k.alias("reading_id"), labels.alias("label"), ts.alias("ts"), F.when(k % 5 != 0, F.col("value")).alias("put_volume_ratio"), F.when(k % 11 != 0, (k % 7).cast("double")).alias("put_call_ratio"))
    first, last = readings.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    width = ((last or 0) - (first or 0)) // BATCHES + 1
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        for batch in range(BATCHES):
            some = readings.where(F.floor((F.unix_micros("ts") - F.lit(first)) / width) == batch)
            some.write.mode("append").parquet(f"{folder}/readings")
            stream = spark.readStream.schema(readings.schema).parquet(f"{folder}/readings")
            rows = P.pull(R.flow_readings(stream), folder)
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return rows.select("ticker", "reading_id", "label", "measure", "before_id", "before", "trend")
