"""Structured regulatory facts: flattening, selection, period alignment and shares of a total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FACT_SCHEMA = "cik STRING, facts MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<val: DOUBLE, start: DATE, `end`: DATE, form: STRING, filed: DATE, fy: INT, fp: STRING, accn: STRING>>>>>>"


def flatten_facts(json: DataFrame) -> DataFrame:
    """One row per fact from nested documents (taxonomy, concept, unit, facts)."""
    concepts = json.select("cik", F.explode("facts").alias("taxonomy", "concepts"))
    units = concepts.select("cik", "taxonomy", F.explode("concepts").alias("concept", "body"))
    rows = units.select("cik", "taxonomy", "concept", F.explode("body.units").alias("unit", "values"))
    return rows.select("cik", "taxonomy", "concept", "unit", F.inline("values"))


def filings_from_arrays(submissions: DataFrame) -> DataFrame:
    """One row per filing from parallel arrays (form, filing_date, accession)."""
    zipped = F.arrays_zip("form", "filing_date", "accession")
    return submissions.select("cik", F.posexplode(zipped).alias("position", "f")).select("cik", "position", "f.*")


def material_filings(filings: DataFrame, noisy: tuple[str, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """Filings whose form is none of the noisy ones and starts with an allowed prefix."""
    allowed = F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith("form", p))
    return filings.where(~F.col("form").isin(*noisy) & allowed)


def in_window(rows: DataFrame, day: str, start: str, end: str, lookback: int, as_of: str) -> DataFrame:
    """Rows whose date is in a range and not older than a lookback; a null date is not."""
    return rows.where(F.col(day).between(start, end) & (F.col(day) >= F.date_sub(F.lit(as_of).cast("date"), lookback)))


def soft_filter(rows: DataFrame, key: str, condition) -> DataFrame:
    """Rows of each key that meet a condition, or all of the key's if none does."""
    n = F.count_if(condition).over(Window.partitionBy(key))
    return rows.withColumn("n_met", n).where(condition | (F.col("n_met") == 0)).drop("n_met")


def period_band(facts: DataFrame) -> DataFrame:
    """Facts with the kind of their period: quarterly (60 to 110 days), annual (340 to 400) or other."""
    days = F.datediff("end", "start")
    kind = F.when(days.between(60, 110), "quarterly").when(days.between(340, 400), "annual").otherwise("other")
    return facts.withColumn("days", days).withColumn("band", kind)


def near_filing(facts: DataFrame, filings: DataFrame, days: int = 10) -> DataFrame:
    """For each filing how many of its key's facts were filed within some days, and the first such date (null if there is none).

    The interval join is an equi-join on the key and the week, with each filing copied
    to the weeks its interval touches.
    """
    week = lambda c: F.floor(F.unix_date(c) / 7)
    first, last = week(F.date_sub("filing_date", days)), week(F.date_add("filing_date", days))
    wanted = filings.withColumn("week", F.explode(F.sequence(first, last)))
    dated = facts.withColumn("week", week(F.col("filed")))
    near = wanted.join(dated, ["ticker", "week"]).where(F.abs(F.datediff("filed", "filing_date")) <= days)
    found = near.groupBy("ticker", "filing_id").agg(F.count("*").alias("n_facts"), F.min("filed").alias("first_filed"))
    return filings.join(found, ["ticker", "filing_id"], "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0).cast("long")))


def latest_annual(facts: DataFrame, concepts: list[str]) -> DataFrame:
    """The newest fact of the first concept, in the order given, that a ticker has."""
    place = F.array_position(F.array(*[F.lit(c) for c in concepts]), F.col("concept"))
    best = Window.partitionBy("ticker").orderBy("place", F.col("end").desc(), F.col("filed").desc())
    rows = facts.where(F.col("concept").isin(concepts)).withColumn("place", place).withColumn("rn", F.row_number().over(best))
    return rows.where("rn = 1").select("ticker", "concept", "end", "value")


def share_of_total(facts: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """The sum of each part and its share of the key's total."""
    sums = facts.groupBy(*keys, part).agg(F.sum(value).alias("amount"))
    total = F.sum("amount").over(Window.partitionBy(*keys))
    return sums.withColumn("total", total).withColumn("share", F.try_divide("amount", "total"))


def concentration(facts: DataFrame, keys: list[str], part: str, value: str, least: float = 0.1) -> DataFrame:
    """The largest part of each key, how many have at least a tenth of the total, and the sum of squared shares."""
    shares = share_of_total(facts, keys, part, value)
    return shares.groupBy(*keys).agg(F.max_by(part, F.struct("amount", part)).alias("largest"), F.max("share").alias("largest_share"), F.count_if(F.col("share") >= least).alias("n_large"), F.round(F.sum(F.col("share") * F.col("share")), 9).alias("hhi"))
