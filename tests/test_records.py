"""Records of pages in many shapes, and times in many forms."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import records as R

BASE = "https://ir.example.com/news/index.html?p=1"
RECORD = {"title": "Results", "url": "q4.html", "publishedAt": "2024-02-01T10:00:00-05:00"}
JSON = {
    "items": {"items": [RECORD, 5, "x", {"headline": " Next ", "link": "/a", "date": 1700000000, "description": "s"}]},
    "releases": {"items": [], "releases": [RECORD]},
    "news": {"items": "none", "news": [3, RECORD]},
    "data list": {"data": [RECORD]},
    "data values": {"data": {"b": [RECORD], "a": "x", "c": [{"title": "later"}]}},
    "feed": {"feed": {"items": [RECORD]}, "data": {"z": [{"title": "not this"}]}},
    "no title": {"items": [{"url": "x"}]},
    "list": [RECORD],
    "empty": {},
}


def test_json(spark):
    names = [*JSON, "bad", "null"]
    bodies = [json.dumps(v) for v in JSON.values()] + ["{no json", None]
    pages = spark.createDataFrame([(i, BASE, b) for i, b in enumerate(bodies)], "id long, base string, body string")
    got = {}
    for r in R.json_records(pages).collect():
        got.setdefault(names[r["id"]], []).append((r["position"], r["title"], r["summary"], r["url"], r["time_form"], r["status"]))
    one = [(0, "Results", None, "https://ir.example.com/news/q4.html", "iso", "OK")]
    assert got["items"] == [*one, (1, "Next", "s", "https://ir.example.com/a", "epoch_s", "OK")]
    assert all(got[n] == one for n in ("releases", "news", "data list", "data values", "feed"))
    assert got["no title"] == [(0, None, None, "https://ir.example.com/news/x", None, "NO_TITLE")]
    assert all(got[n] == [(None, None, None, None, None, "NO_RECORDS")] for n in ("list", "empty"))
    assert all(got[n] == [(None, None, None, None, None, "BAD_JSON")] for n in ("bad", "null"))


def test_html(spark):
    article = '<article><h3>Fourth <b>quarter</b></h3><a class="x" href="//cdn.example.org/a?b&amp;c">more</a><time datetime="2024-03-01">1 March</time></article>'
    entries = "<ul><li><a href='#top'>Company announces results</a> <time>Fri, 01 Mar 2024 09:30:00 GMT</time></li><li>Contact</li><li><a href='?x'>News</a> earnings</li></ul>"
    pages = spark.createDataFrame([(1, BASE, article + entries), (2, BASE, entries), (3, BASE, "<p>x</p>"), (4, BASE, None)], "id long, base string, body string")
    got = {(r["id"], r["position"]): (r["title"], r["url"], r["time_form"], r["status"]) for r in R.html_records(pages).collect()}
    assert got == {
        (1, 0): ("Fourth quarter", "https://cdn.example.org/a?b&c", "date", "OK"),
        (2, 0): ("Company announces results", BASE + "#top", "rfc2822", "OK"),
        (2, 1): (None, "https://ir.example.com/news/index.html?x", None, "NO_TITLE"),
        (3, None): (None, None, None, "NO_RECORDS"),
        (4, None): (None, None, None, "NO_RECORDS"),
    }


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times(spark, zone):
    want = {
        "20240301": ("2024-03-01 00:00:00", "compact"), "20240301093015": ("2024-03-01 09:30:15", "compact"), "20241301": None, "2024-03-01": ("2024-03-01 00:00:00", "date"), "2024-02-30": None,
        "1709285415": ("2024-03-01 09:30:15", "epoch_s"), "1709285415.5": ("2024-03-01 09:30:15", "epoch_s"), "1709285415000": ("2024-03-01 09:30:15", "epoch_ms"),
        "2024-03-01T09:30:15Z": ("2024-03-01 09:30:15", "iso"), "2024-03-01 09:30": ("2024-03-01 09:30:00", "iso"), "2024-03-01T09:30:15.25+0530": ("2024-03-01 04:00:15", "iso"), "2024-03-01T25:30:15Z": None,
        "Fri, 01 Mar 2024 09:30:15 GMT": ("2024-03-01 09:30:15", "rfc2822"), "1 March 2024 04:30:15 EST": ("2024-03-01 09:30:15", "rfc2822"), " Fri, 1 Mar 2024 10:30 +0100 ": ("2024-03-01 09:30:00", "rfc2822"), "31 Foo 2024 10:30 GMT": None,
        "yesterday": None, "": None, "12345": None,
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "raw string").select("raw", R.normalised_time(F.col("raw")).alias("t")).select("raw", F.unix_seconds("t.ts").alias("s"), "t.form").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {r["raw"]: r["s"] is not None and (datetime.fromtimestamp(r["s"]).astimezone(__import__("datetime").timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), r["form"]) or None for r in rows}
    assert got == want | {None: None}


def test_transcripts(spark):
    bodies = [
        {"transcript": [{"speaker": "A", "content": "Hello."}, 3, {"speaker_name": "B", "text": " Hi. "}, {"speaker": "C", "content": " "}, {"content": "No name."}]},
        {"Note": "slow down", "transcript": [{"content": "x"}]}, {"transcript": "none"}, {"transcript": []}, [1],
    ]
    pages = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(5, "{"), (6, None)], "id long, body string")
    got = [tuple(r) for r in R.transcript_paragraphs(pages).collect()]
    assert sorted(got, key=lambda r: (r[0], r[1] or 0)) == [
        (0, 0, "A", "Hello.", "OK"), (0, 1, "B", "Hi.", "OK"), (0, 2, None, "No name.", "OK"), (1, None, None, None, "RATE_LIMITED_OR_UNAVAILABLE"),
        (2, None, None, None, "NOT_FOUND"), (3, None, None, None, "NOT_FOUND"), (4, None, None, None, "FETCH_ERROR"), (5, None, None, None, "FETCH_ERROR"), (6, None, None, None, "FETCH_ERROR"),
    ]
