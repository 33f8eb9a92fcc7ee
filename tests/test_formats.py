"""File formats in and out."""

import json

from tallyworks.operators import companies, facts, filings
from tallyworks.sources import formats
from pyspark.sql import functions as F


def test_submissions(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"cik": "1", "filings": {"recent": {"form": ["10-K", "8-K"], "filingDate": ["2024-01-02", "2024-02-03"], "accessionNumber": ["a", "b"]}}}))
    rows = facts.filings_from_arrays(formats.read_submissions(spark, str(tmp_path / "s.json"))).collect()
    assert [(r["position"], r["form"], str(r["filing_date"]), r["accession"]) for r in rows] == [(0, "10-K", "2024-01-02", "a"), (1, "8-K", "2024-02-03", "b")]


def test_news_in_seconds_and_milliseconds(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([{"id": 1, "headline": "a", "datetime": 1747312200}, {"id": 2, "headline": "b", "datetime": 1747312200000}]))
    rows = formats.read_news_json(spark, str(tmp_path / "n.json")).select("id", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm").alias("t")).collect()
    assert {r["t"] for r in rows} == {"2025-05-15T12:30"}


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>u</link><pubDate>Thu, 15 May 2025 12:30:00 GMT</pubDate><category domain='stock'>NYSE:ABC</category></item></channel></rss>")
    row = formats.read_rss(spark, str(tmp_path / "f.xml")).select("title", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("t"), F.col("category")[0]["_VALUE"].alias("c")).first()
    assert (row["title"], row["t"], row["c"]) == ("T", "2025-05-15 12:30", "NYSE:ABC")


def test_pages_and_sinks(spark, tmp_path):
    (tmp_path / "p.html").write_text("<h1>a</h1>\n<p>b</p>")
    assert formats.read_pages(spark, str(tmp_path / "p.html")).first()["html"] == "<h1>a</h1>\n<p>b</p>"
    formats.write_text(formats.enveloped(spark.range(1), "t", "2024-01-01"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"ok": True, "data": {"id": 0}, "meta": {"tool": "t", "asOf": "2024-01-01"}}
    formats.write_json(spark.range(3), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_issuer_identity(spark):
    got = companies.identities(spark.createDataFrame([("A", "International Machines of Business, Inc.")], "ticker string, name string")).first()
    assert got["aliases"] == ["international machines of business inc", "international machines of business"] and got["acronym"] == "imb"
