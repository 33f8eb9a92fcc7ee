"""Exact expected values of single operators on small literal tables."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyworks.functions import ladders
from tallyworks.operators import analyst, documents, events, facts, filing_index, fundamentals, funds, options, timeseries

D = dt.date


def bars(spark, closes, ticker="A", **more):
    rows = [(ticker, D(2024, 1, 1) + dt.timedelta(days=i), float(c), float(more.get("adj", closes)[i])) for i, c in enumerate(closes)]
    b = spark.createDataFrame(rows, "ticker string, d date, close double, adj_close double")
    return b.select("*", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), F.lit(10).cast("long").alias("volume"))


def test_slope(spark):
    got = timeseries.price_slope(bars(spark, [100, 102, 104], adj=[50, 51, 52]), 3).first()
    assert (got["first_adj"], got["last_adj"], got["last_close"], got["direction"]) == (50.0, 52.0, 104.0, "UP")


def test_rsi_and_macd_like_pandas(spark):
    closes = pd.Series([100 + 7 * ((i * 37) % 11) - i * 0.3 for i in range(80)])
    change = closes.diff()
    gain, loss = change.where(change > 0, 0.0), (-change).where(change < 0, 0.0)
    mean = [s.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean().iloc[-1] for s in (gain, loss)]
    got = timeseries.rsi(bars(spark, closes)).first()["rsi_14"]
    assert got == pytest.approx(100 - 100 / (1 + mean[0] / mean[1]), rel=1e-12)
    line = closes.ewm(span=12, adjust=False).mean() - closes.ewm(span=26, adjust=False).mean()
    signal = line.ewm(span=9, adjust=False).mean()
    got = timeseries.macd(bars(spark, closes)).first()
    assert (got["macd"], got["macd_signal"]) == (pytest.approx(line.iloc[-1], rel=1e-9), pytest.approx(signal.iloc[-1], rel=1e-9))


def test_rsi_of_rising_and_flat_prices(spark):
    assert timeseries.rsi(bars(spark, range(1, 40))).first()["rsi_14"] == 100.0
    assert timeseries.rsi(bars(spark, [5] * 40)).first()["rsi_14"] is None
    assert timeseries.rsi(bars(spark, [5, 6])).first()["rsi_14"] is None


def credit(spark, items, debt, cash, quarters=4):
    rows = [("A", D(2024, 3 * q + 1, 1), k, float(v)) for q in range(quarters) for k, v in items.items()]
    st = spark.createDataFrame(rows, "ticker string, period date, line_item string, value double")
    return fundamentals.credit_health(st, spark.createDataFrame([("A", float(debt), float(cash))], "ticker string, total_debt double, cash double")).first()


def test_credit_of_one_quarter(spark):
    got = credit(spark, {"EBITDA": 40, "Operating Income": 20, "Interest Expense": -5}, 100, 20, 1)
    assert (got["coverage_ebit"], got["coverage_ebitda"]) == (4.0, 8.0)


def test_credit_over_a_year(spark):
    got = credit(spark, {"EBITDA": 920e6, "Operating Income": 100e6, "Reconciled Depreciation": 40e6, "Interest Expense": 52.8e6}, 1000e6, 100e6)
    assert (got["interest"], got["provider_ebitda"], got["operating_ebitda"]) == (211.2e6, 3680e6, 560e6)
    assert round(got["net_debt_to_ebitda"], 2) == 1.61 and round(got["coverage_ebitda"], 2) == 2.65 and got["ebitda_divergence"]


def test_credit_without_depreciation(spark):
    got = credit(spark, {"EBITDA": 150, "Operating Income": 100}, 10, 0)
    assert (got["ebitda"], got["ebitda_source"]) == (600.0, "provider_ebitda_fallback")


def test_share_trend(spark):
    rows = [("A", D(2024, 6, 1), 1, 110), ("A", D(2024, 1, 1), 2, 100), ("A", D(2024, 3, 1), 3, 105), ("A", D(2024, 3, 1), 4, 110)]
    got = fundamentals.share_trend(spark.createDataFrame(rows, "ticker string, d date, seq long, shares long")).first()
    assert (got["first_shares"], got["current_shares"], got["n_samples"], round(got["change_pct"], 6)) == (100, 110, 2, 10.0)


def test_suffixed_numbers(spark):
    raw = spark.createDataFrame([("1,234.5M",), ("3.2B",), ("-7",), ("n/a",), (None,)], "t string")
    assert [r[0] for r in raw.select(fundamentals.parse_suffixed(F.col("t"))).collect()] == [1234.5e6, 3.2e9, -7.0, None, None]


def chain(spark, good, bad):
    rows = [("A", D(2024, 2, 1), "call", 100 + i, 1.0, 1.1, 5, 50, 0.3, D(2024, 1, 30)) for i in range(good)]
    rows += [("A", D(2024, 2, 1), "put", 200 + i, 0.0, 0.0, 0, 0, 0.00001, D(2023, 1, 1)) for i in range(bad)]
    return spark.createDataFrame(rows, "ticker string, expiration date, kind string, strike long, bid double, ask double, volume long, open_interest long, iv double, last_trade date")


@pytest.mark.parametrize("good,bad,quality", [(0, 10, "LOW"), (10, 0, "HIGH"), (6, 4, "MEDIUM")])
def test_chain_quality(spark, good, bad, quality):
    assert options.chain_quality(chain(spark, good, bad), "2024-01-31").first()["quality"] == quality


def test_valid_quotes_come_first(spark):
    spot = spark.createDataFrame([("A", 200.0)], "ticker string, spot double")
    got = options.most_relevant(chain(spark, 2, 2), spot).orderBy("relevance").collect()
    assert [r["strike"] for r in got] == [101, 100, 200, 201]


def test_max_pain_takes_the_lowest_of_equal_strikes(spark):
    rows = [("A", D(2024, 2, 1), "call", 10, 5), ("A", D(2024, 2, 1), "put", 20, 5)]
    got = options.max_pain(spark.createDataFrame(rows, "ticker string, expiration date, kind string, strike long, open_interest long")).first()
    assert (got["max_pain"], got["payout"]) == (10, 50)


def test_analyst_changes(spark):
    rows = [("A", D(2024, 1, i + 1), i, i, *r) for i, r in enumerate([(None, "Buy", "init"), ("Hold", "Buy", "up"), ("Buy", "Sell", "down"), ("Buy", "Buy", "main")])]
    got = analyst.change_radar(spark.createDataFrame(rows, "ticker string, grade_date date, firm long, seq long, from_grade string, to_grade string, action string"), "2024-01-31").first()
    assert (got["initiated"], got["upgrades"], got["downgrades"], got["maintained"]) == (1, 1, 1, 1)


def test_surprises(spark):
    rows = [("A", D(2024, 1, 1), 2.31, 2.25), ("B", D(2024, 1, 1), 0.11, -0.0075)]
    got = {r["ticker"]: r for r in analyst.surprises(spark.createDataFrame(rows, "ticker string, period date, actual double, estimate double")).collect()}
    assert (round(got["A"]["delta"], 2), round(got["A"]["surprise_pct"], 2)) == (0.06, 2.67)
    assert (round(got["B"]["delta"], 4), got["B"]["surprise_pct"]) == (0.1175, None)


def test_duplicate_groups(spark):
    t = dt.datetime(2024, 1, 1, 9)
    rows = [(1, "A", "wire", 2, "Big News, Inc. https://x.y/1", t), (2, "A", "filing", 0, "big news  https://z.q/2?x", t + dt.timedelta(hours=1)), (3, "A", "wire", 2, "other", t)]
    news = spark.createDataFrame(rows, "item_id long, ticker string, source string, source_rank int, title string, published_at timestamp")
    got = {r["item_id"]: r for r in events.keep_best(news).collect()}
    assert set(got) == {2, 3} and (got[2]["n_items"], got[2]["other_ids"]) == (2, "1")


def test_ticker_mentions(spark):
    rows = spark.createDataFrame([("TSXV:MRVL up",), ("NASDAQ:MRVL up",), ("MRVL up",), ("XMRVL up",)], "t string")
    assert [r[0] for r in rows.select(events.mentions_ticker(F.col("t"), "MRVL", ("NASDAQ", "NYSE"))).collect()] == [False, True, True, False]


def test_reported_metric_and_period(spark):
    text = "Revenue was $18.8 million in the year. The company expects revenue of $130 million."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert documents.reported_metric(docs, "revenue", "(?i)expects").first()["value"] == pytest.approx(18.8e6)
    period = spark.createDataFrame([("Fiscal 2026 Fourth Quarter results; fourth quarter of fiscal 2025",)], "t string")
    assert period.select(documents.fiscal_period(F.col("t"))).first()[0] == "FY2026 Q4"


def test_nested_tables(spark):
    html = "<table><tr><th>a</th><td>b<table><tr><td>in &amp; out</td></tr></table></td></tr><tr><td>c</td></tr></table>"
    rows = filing_index.html_tables(spark.createDataFrame([(1, html)], "doc_id long, html string")).orderBy("position").collect()
    assert [r["rows"] for r in rows] == [[["a", "b"], ["c"]], [["in & out"]]]


def test_insider_transactions(spark):
    xml = "<o><rptOwnerName>N</rptOwnerName><nonDerivativeTransaction><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>1000</value></transactionShares><transactionPricePerShare><value>12.50</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></o>"
    got = documents.insider_transactions(spark.createDataFrame([(1, xml)], "doc_id long, xml string")).first()
    assert (got["value"], got["kind"]) == (12500.0, "Purchase")


def test_flattened_facts(spark):
    fact = '{"val": 391035000000, "start": "2023-10-01", "end": "2024-09-28", "form": "10-K", "filed": "2024-11-01", "fy": 2024, "fp": "FY", "accn": "x"}'
    older = fact.replace("391035000000", "383285000000").replace("2024-09-28", "2023-09-30")
    doc = '{"cik": "1", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [' + older + "," + fact + "]}}}}}"
    rows = spark.createDataFrame([(doc,)], "j string").select(F.from_json("j", facts.FACT_SCHEMA).alias("j")).select("j.*")
    flat = facts.flatten_facts(rows).withColumnsRenamed({"cik": "ticker", "val": "value"})
    got = facts.latest_annual(flat, ["Revenues"]).first()
    assert (got["value"], got["end"]) == (391035000000.0, D(2024, 9, 28))


def test_fund_classes(spark):
    nav = spark.createDataFrame([(1, "main", D(2026, 7, 10), 1, 10.0), (1, "main", D(2026, 7, 9), 2, 9.0), (2, "A", D(2026, 7, 1), 3, 1.0), (2, "B", D(2026, 7, 1), 4, 1.0)], "proj_id long, fund_class string, nav_date date, seq long, last_val double")
    asked = spark.createDataFrame([(1, "x"), (2, "main"), (3, "main")], "proj_id long, wanted string")
    got = {r["proj_id"]: (r["status"], r["nav_date"], r["last_val"]) for r in funds.batch_nav(asked, nav).collect()}
    assert got == {1: ("OK_SINGLE_CLASS", D(2026, 7, 10), 10.0), 2: ("AMBIGUOUS", None, None), 3: ("UNVERIFIED_NO_ROWS", None, None)}


@pytest.mark.parametrize("last,as_of,want", [(D(2024, 1, 5), "2024-01-06 12:00:00", "WEEKEND_EXPECTED_STALE"), (D(2024, 1, 9), "2024-01-10 12:00:00", "FRESH"), (D(2024, 1, 8), "2024-01-10 12:00:00", "MARKET_CLOSED_EXPECTED_STALE"), (D(2024, 1, 4), "2024-01-10 12:00:00", "STALE"), (D(2023, 12, 1), "2024-01-10 12:00:00", "VERY_STALE"), (D(2024, 1, 10), "2024-01-10 12:00:00", "UNKNOWN")])
def test_freshness(spark, last, as_of, want):
    rows = spark.createDataFrame([("A", last)], "ticker string, d date")
    assert timeseries.freshness(rows, as_of).first()["freshness"] == want


def test_ladders(spark):
    rows = spark.createDataFrame([(None,), (0.5,), (1.0,), (2.0,)], "x double")
    assert [r[0] for r in rows.select(ladders.volume_flag(F.col("x"))).collect()] == [None, "LOW", "NORMAL", "HIGH"]
    assert [r[0] for r in rows.select(ladders.debt_tier(F.col("x"))).collect()] == [None, "CLEAN", "MODERATE", "MODERATE"]


def test_sections_as_of(spark):
    found = spark.createDataFrame([(1, 5, 0), (1, 50, 1), (1, 5000, 2), (2, 7, 0)], "doc_id long, pos int, match_id long")
    sections = spark.createDataFrame([(1, 10, "a"), (1, 40, "b")], "doc_id long, start int, section string")
    got = {(r["doc_id"], r["match_id"]): r["section"] for r in documents.section_of(found, sections, 100).collect()}
    assert got == {(1, 0): None, (1, 1): "b", (1, 2): None, (2, 0): None}


def test_cell_numbers(spark):
    from tallyworks.operators.filings import cell_number

    want = {"(123)": -123.0, "$ 2.5B": 2.5e9, "12%": 12.0, "1,234.5": 1234.5, "-7": -7.0, "3m": 3e6, "4K": 4e3, "$(1,000)": -1000.0, "n/a": None, "": None, "B": None}
    cells = spark.createDataFrame([(c,) for c in want], "cell string")
    assert {r["cell"]: r["n"] for r in cells.select("cell", cell_number(cells["cell"]).alias("n")).collect()} == want


def test_coverage_ladders(spark):
    rows = [("in millions", True, True), ("in millions", True, False), (None, True, True), ("none", False, False)]
    t = spark.createDataFrame(rows, "text string, years boolean, labels boolean").coalesce(1)
    unit = ladders.table_unit(F.col("text"))
    got = t.select(unit.alias("unit"), ladders.table_confidence(F.col("years"), F.col("labels"), unit).alias("level")).collect()
    assert [tuple(r) for r in got] == [("millions", "HIGH"), ("millions", "MEDIUM"), ("unknown", "MEDIUM"), ("unknown", "LOW")]
    signal, driver = ladders.forward_revision(F.col("w"), F.col("m"), F.col("s"))
    cases = [(5.0, 1.0, None), (-5.0, 4.0, None), (None, None, -3.0), (None, None, None), (1.0, None, 9.0)]
    got = spark.createDataFrame(cases, "w double, m double, s double").coalesce(1).select(signal.alias("signal"), driver.alias("driver")).collect()
    assert [tuple(r) for r in got] == [("POSITIVE", "30d_neutral_7d"), ("POSITIVE", "30d"), ("NEGATIVE", "90d_fallback"), ("UNKNOWN", "none"), ("NEUTRAL", "7d")]
