"""What an earnings release says of its fiscal period and of guidance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a quarter is named, the forms of a period (pattern, place of the quarter, place of the year), and the factors of a scale.
QUARTERS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4}
QUARTER = "(" + "|".join(QUARTERS) + ")"
PERIODS = (
    (rf"(?i)\b{QUARTER}\s+quarter(?:\s+and\s+(?:full\s+)?fiscal\s+year)?(?:\s+of)?\s+(?:fiscal\s+)?(20\d\d)\b", 1, 2),
    (r"(?i)\bQ([1-4])\s*(?:of\s*)?(?:FY|fiscal\s+year)\s*(20\d\d)\b", 1, 2),
    (rf"(?i)\bfiscal\s+(20\d\d)\b.{{0,80}}?\b{QUARTER}\s+quarter\b", 2, 1),
)
SCALES = (("billion", 1e9), ("bn", 1e9), ("b", 1e9), ("million", 1e6), ("m", 1e6), ("thousand", 1e3), ("k", 1e3))
NUMBER = r"\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|million|thousand|bn|[mk]\b)?"
OUTLOOK = r"(?:expects|guidance|outlook)[^.\n]{0,120}"
RANGE = r"\s*(?:to|-|–|and)\s*"
#: Metric, pattern, whether numbers are scaled, unit.
GUIDANCE = (
    ("revenue", rf"(?i){OUTLOOK}revenue[^$0-9]{{0,25}}{NUMBER}{RANGE}{NUMBER}", True, "USD"),
    ("grossMargin", rf"(?i)gross margin[^0-9]{{0,20}}([0-9]{{1,2}}(?:\.[0-9]+)?)()\s*%?{RANGE}([0-9]{{1,2}}(?:\.[0-9]+)?)()\s*%", False, "percent"),
    ("eps", rf"(?i){OUTLOOK}(?:eps|earnings per share)[^$0-9]{{0,25}}\$?\s*([0-9]+(?:\.[0-9]+)?)(){RANGE}\$?\s*([0-9]+(?:\.[0-9]+)?)()", False, "USD/share"),
)


def release_period(text: Column) -> Column:
    """A struct of period (``FY2026 Q4``), status (RESOLVED or UNRESOLVED) and evidence: the form that stands earliest in the text counts."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    found = []
    for pattern, quarter, year in PERIODS:
        word = F.lower(F.regexp_extract(plain, pattern, quarter))
        number = F.coalesce(*[F.when(word == q, str(n)) for q, n in QUARTERS.items()], word)
        at = F.regexp_instr(plain, F.lit(pattern))
        told = F.concat(F.lit("FY"), F.regexp_extract(plain, pattern, year), F.lit(" Q"), number)
        found.append(F.when(at > 0, F.struct(at.alias("at"), told.alias("period"), F.regexp_extract(plain, pattern, 0).alias("evidence"))))
    first = reduce(F.least, found)
    return F.struct(first["period"].alias("period"), F.when(first.isNull(), "UNRESOLVED").otherwise("RESOLVED").alias("status"), first["evidence"].alias("evidence"))


def _amount(number: Column, scale: Column) -> Column:
    factor = F.coalesce(*[F.when(F.lower(scale) == s, f) for s, f in SCALES], F.lit(1.0))
    return F.regexp_replace(number, ",", "").try_cast("double") * factor


def guidance(texts: DataFrame) -> DataFrame:
    """doc_id, metric, low, high, midpoint, unit, status and excerpt for revenue, gross margin and earnings per share of each text (doc_id, text).

    Status FOUND or NOT_DISCLOSED. A scale that stands behind the second number only holds for both.
    """
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\f]+", " ")
    # the text is searched once a metric; the parts are cut from what was found
    found = texts.select("doc_id", *[F.regexp_extract(plain, pattern, 0).alias(metric) for metric, pattern, _, _ in GUIDANCE])
    rows = []
    for metric, pattern, scaled, unit in GUIDANCE:
        low, low_scale, high, high_scale = (F.regexp_extract(metric, pattern, i) for i in (1, 2, 3, 4))
        if scaled:
            low, high = _amount(low, F.when(low_scale == "", high_scale).otherwise(low_scale)), _amount(high, high_scale)
        else:
            low, high = low.try_cast("double"), high.try_cast("double")
        rows.append(F.struct(F.lit(metric).alias("metric"), low.alias("low"), high.alias("high"), F.lit(unit).alias("unit"), F.nullif(F.trim(metric), F.lit("")).alias("excerpt")))
    told = found.select("doc_id", F.inline(F.array(*rows)))
    both = F.col("low").isNotNull() & F.col("high").isNotNull()
    kept = lambda c: F.when(both, F.col(c)).alias(c)
    return told.select("doc_id", "metric", kept("low"), kept("high"), ((F.col("low") + F.col("high")) / 2).alias("midpoint"), "unit", F.when(both, "FOUND").otherwise("NOT_DISCLOSED").alias("status"), kept("excerpt"))
