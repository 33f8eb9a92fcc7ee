"""Periods and guidance of releases, fixed values."""

from pyspark.sql import functions as F

from tallyworks.operators.releases import guidance, release_period

PERIODS = {
    "Acme Reports Fiscal 2026 Fourth Quarter Results. Sales rose, compared to the fourth quarter of fiscal 2025.": "FY2026 Q4",
    "in the third  quarter of\nfiscal 2026, and the second quarter of fiscal 2025": "FY2026 Q3",
    "the second quarter of fiscal 2025, against the third quarter of fiscal 2026": "FY2025 Q2",
    "Reports Fourth Quarter and Full Fiscal Year 2026 Results": "FY2026 Q4",
    "3rd quarter 2024": "FY2024 Q3",
    "Q2 FY2026 and first quarter of 2025": "FY2026 Q2",
    "Q1 of fiscal year 2027": "FY2027 Q1",
    "fiscal 2026 was a year" + " x" * 60 + " first quarter": None,
    "fiscal year without a number": None,
    "": None,
}


def test_periods(spark):
    rows = spark.createDataFrame([(t,) for t in PERIODS] + [(None,)], "text string").select("text", release_period(F.col("text")).alias("p")).collect()
    assert {r["text"]: r["p"]["period"] for r in rows} == PERIODS | {None: None}
    assert all((r["p"]["status"] == "RESOLVED") == (r["p"]["period"] is not None) for r in rows)
    assert next(r["p"]["evidence"] for r in rows if r["text"] and "Acme" in r["text"]) == "Fiscal 2026 Fourth Quarter"


def test_guidance(spark):
    texts = {
        1: "The company expects revenue of $1.2 billion to $1.4 billion, gross margin of 45% to 46.5%, and its outlook for EPS is $1.10 - $1.30.",
        2: "Guidance: revenue between 120 and 130 million. Gross margin 40 - 42%.",
        3: "Outlook for revenue: $900m to $1bn. We guide earnings per share up.",
        4: "Revenue was $5 million to remember. No guidance is given.",
        5: None,
        6: "expects revenue of $1,200 thousand - $1,300 thousand",
    }
    got = {(r["doc_id"], r["metric"]): (r["low"], r["high"], r["midpoint"]) for r in guidance(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect() if r["status"] == "FOUND"}
    assert got == {
        (1, "revenue"): (1.2e9, 1.4e9, 1.3e9), (1, "grossMargin"): (45.0, 46.5, 45.75), (1, "eps"): (1.1, 1.3, 1.2000000000000002),
        (2, "revenue"): (120e6, 130e6, 125e6), (2, "grossMargin"): (40.0, 42.0, 41.0), (3, "revenue"): (900e6, 1e9, 950e6), (6, "revenue"): (1.2e6, 1.3e6, 1.25e6),
    }
