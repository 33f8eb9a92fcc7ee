"""Incremental pulls over stops and growth, and readings over several batches."""

import json
from datetime import datetime, timedelta

import pytest

from tallyworks.streaming import pages as P
from tallyworks.streaming import readings as R

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def put(top, feed, cursor, items, following=None):
    folder = top / f"feed={feed}" / f"cursor={P.folder_name(cursor)}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "page.json").write_text(items if isinstance(items, str) else json.dumps({"items": items, "next_cursor": following}))


def test_restart_gives_each_row_once(spark, tmp_path):
    top, out = tmp_path / "in", str(tmp_path / "out")
    pull = lambda: sorted((r["feed"], r["cursor"], r["item"]) for r in P.pull(P.feed_stream(spark, str(top)), out).collect())
    put(top, "IPO", "start", [{"id": 1}, {"id": 2}], "a/b")
    put(top, "IPO", "a/b", [{"id": 3}], "c")  # its next page is not there yet
    put(top, "SALE", "start", [], "x")
    put(top, "SALE", "x", [{"id": "é"}])
    first = [("IPO", "a/b", '{"id": 3}'), ("IPO", "start", '{"id": 1}'), ("IPO", "start", '{"id": 2}'), ("SALE", "x", '{"id": "é"}')]
    assert pull() == first and pull() == first
    put(top, "IPO", "c", "no json")
    assert pull() == first
    put(top, "IPO", "c", [{"id": 4}], "start")  # a circle ends
    put(top, "SALE", "x", [{"id": "é"}], "y")  # the last page has a next one now
    put(top, "SALE", "y", [{"id": 5}])
    put(top, "NEW", "start", [{"id": 6}])
    more = sorted([*first, ("IPO", "c", '{"id": 4}'), ("SALE", "y", '{"id": 5}'), ("NEW", "start", '{"id": 6}')])
    assert pull() == more and pull() == more


def test_offsets(tmp_path):
    put(tmp_path, "f", "start", [1], "b")
    put(tmp_path, "f", "b", [2])
    reader = P.PageReader(f"file://{tmp_path}")
    assert reader.initialOffset() == {} and reader.latestOffset() == {"f": {"pages": 2, "cursor": "b"}}
    put(tmp_path, "f", "b", [2], "c")
    put(tmp_path, "f", "c", [3])
    assert [p.cursor for p in reader.partitions({"f": {"pages": 1, "cursor": "start"}}, reader.latestOffset())] == ["b", "c"]
    assert P.PageReader(str(tmp_path / "nowhere")).latestOffset() == {}
    with pytest.raises(ValueError):
        list(reader.read(P.Page("f", "gone")))


def test_written_pages(spark, tmp_path):
    rows = spark.createDataFrame([(f, i // 3, (i, f"t{i}")) for f in ("a b", "c") for i in range(10)], "feed string, page int, item struct<id:int,t:string>")
    P.write_pages(rows, str(tmp_path / "in"))
    got = P.pull(P.feed_stream(spark, f"file://{tmp_path}/in"), str(tmp_path / "out")).collect()
    assert sorted((r["feed"], json.loads(r["item"])["id"]) for r in got) == [(f, i) for f in ("a b", "c") for i in range(10)]
    assert len({(r["feed"], r["cursor"]) for r in got}) == 8


def test_readings(spark, tmp_path):
    day = datetime(2024, 3, 1)
    hours = lambda n: day + timedelta(hours=n)
    schema = "ticker string, reading_id long, label string, ts timestamp, put_volume_ratio double, put_call_ratio double"
    batches = [
        [("A", 1, "T-14", hours(0), 1.0, 9.0), ("B", 2, "T-7", hours(0), None, 2.0), ("A", 3, "T-7", hours(1), 1.2, None)],
        [("A", 4, "T-2", hours(72), 1.0, None), ("B", 5, "T-2", hours(73), 1.0, None), ("A", 6, None, hours(73), 1.0, None), ("C", 7, "T-14", hours(0), 0.0, None)],
        [("C", 8, "T-7", hours(2), 5.0, None), ("A", 9, "T-2", hours(74), None, None), ("A", 10, "T-14", hours(400), 1.0, None)],
        [("A", 11, "T-7", hours(401), 1.05, None)],
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            got = P.pull(R.flow_readings(stream, "200 hours"), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r["reading_id"]: (r["measure"], r["before_id"], r["trend"]) for r in got.collect()} == {
        1: (1.0, None, "STABLE"),
        2: (2.0, None, "STABLE"),
        3: (1.2, 1, "INCREASING"),
        4: (1.0, 3, "DECREASING"),
        5: (1.0, None, "STABLE"),  # more than 72 hours
        6: (1.0, None, "STABLE"),
        7: (0.0, None, "STABLE"),
        8: (5.0, 7, "STABLE"),
        9: (None, None, "STABLE"),
        10: (1.0, None, "STABLE"),
        11: (1.05, 10, "STABLE"),
    }


def test_many_pages_are_followed_once_and_read_by_bounded_tasks(tmp_path, monkeypatch):
    for i in range(25):
        put(tmp_path, "f", "start" if i == 0 else f"p{i}", [i], f"p{i + 1}")
    monkeypatch.setattr(P, "MOST_TASKS", 10, raising=False)
    reader = P.PageReader(str(tmp_path))
    end = reader.latestOffset()
    opened = []
    page = P.PageReader._page
    monkeypatch.setattr(P.PageReader, "_page", lambda self, feed, cursor: opened.append(cursor) or page(self, feed, cursor))
    tasks = reader.partitions({}, end)
    assert not opened and len(tasks) <= 10
    assert [json.loads(item) for t in tasks for _, _, item in reader.read(t)] == list(range(25))
    behind = reader.partitions({"f": {"pages": 20, "cursor": "p19"}}, end)
    assert [c for t in behind for c in (t.cursor, *t.more)] == [f"p{i}" for i in range(20, 25)]
    assert [c for t in P.PageReader(str(tmp_path)).partitions({"f": {"pages": 20, "cursor": "p19"}}, end) for c in (t.cursor, *t.more)] == [f"p{i}" for i in range(20, 25)]


def test_a_batch_asks_the_state_of_a_key_once(monkeypatch):
    import pandas as pd

    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or iter(())

    readings = R.FlowReadings()
    readings.kept = readings.handle = State()
    n = 300
    rows = pd.DataFrame({"reading_id": range(n), "label": ["T-14", "T-7", "T-2"] * (n // 3), "ts": pd.date_range("2024-03-01", periods=n, freq="min"), "put_volume_ratio": 1.0, "put_call_ratio": 1.0})
    got = pd.concat(readings.handleInputRows(("A",), iter([rows]), None))
    assert list(got["before_id"][1:3]) == [0, 1] and len(got) == n
    assert len(calls) == 7 and calls.count("updateValue") == calls.count("registerTimer") == 3


def test_a_batch_asks_the_state_of_a_part_once():
    """However many tickers a part has: calls for each of them take too long on large tables."""
    import pandas as pd

    calls, values = [], []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or values.extend(a) or (values[0] if name == "get" and values else None)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    readings = R.PartReadings()
    readings.kept, readings.handle = State(), State()
    n = 300
    rows = pd.DataFrame({"ticker": [f"U{i}" for i in range(n)], "reading_id": range(n), "label": "T-14", "ts": pd.Timestamp("2024-03-01"), "put_volume_ratio": 1.0, "put_call_ratio": None})
    (got,) = readings.handleInputRows((0,), iter([rows]), Times())
    assert len(got) == n and got["before_id"].isna().all() and calls == ["get", "update", "registerTimer"]
    (got,) = readings.handleInputRows((0,), iter([rows.assign(reading_id=range(n, 2 * n), label="T-7", ts=pd.Timestamp("2024-03-02"))]), Times())
    assert (got["reading_id"] - got["before_id"] == n).all() and calls[3:] == ["get", "update", "registerTimer"]


def test_readings_by_part_are_those_by_ticker(spark, tmp_path):
    """Several batches with ties, late rows, a jump in time, missing measures, labels and tickers."""
    import random

    deal = random.Random(7)
    schema = "ticker string, reading_id long, label string, ts timestamp, put_volume_ratio double, put_call_ratio double"
    some = lambda *values: deal.choice(values)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for batch, hours in enumerate((0, 60, 30, 400, 440)):  # the third is late, the fourth is behind what is kept
            rows = [(some(None, "A", "B", "C", "D"), 1000 * batch + i, some(None, "T-14", "T-7", "T-2", "other"), datetime(2024, 3, 1) + timedelta(hours=hours + deal.randrange(60)), some(None, 0.0, 1.0, 2.0), some(None, 1.5)) for i in range(120)]
            spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            by_part, by_ticker = (P.pull(R.flow_readings(stream, "48 hours", parts), str(tmp_path / f"out{parts}")) for parts in (3, None))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got, want = (sorted(map(repr, map(tuple, rows.collect()))) for rows in (by_part, by_ticker))
    assert got == want and 480 < len(got) < 600
    assert by_part.where("before_id % 1000 >= 0 and floor(before_id / 1000) < floor(reading_id / 1000)").count() > 10
