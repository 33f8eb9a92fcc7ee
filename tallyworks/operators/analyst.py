"""Analyst grades, estimates, surprises and target prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ladders

#: Fixed values.
UPGRADE_GRADES = ("buy", "outperform", "overweight", "strong buy", "positive", "market outperform", "top pick")
DOWNGRADE_GRADES = ("sell", "underperform", "underweight", "strong sell", "negative", "market underperform", "reduce")
INITIATION_ACTIONS = ("initiated", "init", "initiation", "new coverage")


def _plain(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def classify_change(ratings: DataFrame) -> DataFrame:
    """The kind of each grade change: its action decides, then the sets its grades are in."""
    action, old, new = _plain("action"), _plain("from_grade"), _plain("to_grade")
    change = (
        F.when(action.isin(*INITIATION_ACTIONS) | action.startswith("init"), "INITIATED")
        .when(F.contains(action, F.lit("downgrade")) | (action == "down"), "DOWNGRADE")
        .when(F.contains(action, F.lit("upgrade")) | (action == "up"), "UPGRADE")
        .when(new.isin(*DOWNGRADE_GRADES) & ~old.isin(*DOWNGRADE_GRADES), "DOWNGRADE")
        .when(new.isin(*UPGRADE_GRADES) & (old != "") & ~old.isin(*UPGRADE_GRADES), "UPGRADE")
        .when((new != "") & (old == ""), "INITIATED")
        .otherwise("MAINTAIN")
    )
    return ratings.withColumn("change", change)


def latest_per_firm(ratings: DataFrame) -> DataFrame:
    newest = Window.partitionBy("ticker", "firm").orderBy(F.col("grade_date").desc(), F.col("seq").desc())
    return ratings.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def change_radar(ratings: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Counts of each kind of change in the last days, by ticker, and their balance."""
    recent = classify_change(ratings).where(F.col("grade_date").between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))
    kinds = {"INITIATED": "initiated", "UPGRADE": "upgrades", "DOWNGRADE": "downgrades", "MAINTAIN": "maintained"}
    out = recent.groupBy("ticker").agg(*[F.count_if(F.col("change") == k).alias(v) for k, v in kinds.items()])
    return out.withColumn("net", F.col("upgrades") - F.col("downgrades"))


def consensus(ratings: DataFrame) -> DataFrame:
    """The dominant grade of the firms' latest ones (the first by name of equal counts), and its share."""
    counts = latest_per_firm(ratings).groupBy("ticker", "to_grade").agg(F.count("*").alias("n"))
    best = Window.partitionBy("ticker").orderBy(F.col("n").desc(), "to_grade")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("ticker"))
    return counts.withColumn("share", share).withColumn("rn", F.row_number().over(best)).where("rn = 1").select("ticker", F.col("to_grade").alias("consensus"), "n", "share")


def pct_change(new: Column, old: Column) -> Column:
    """Percent change with the absolute old value below."""
    return F.try_divide(new - old, F.abs(old)) * 100


def surprises(eps: DataFrame) -> DataFrame:
    """Actual against estimate: difference, percent (none for an estimate within 0.01 of 0), and whether it beat."""
    delta = F.col("actual") - F.col("estimate")
    pct = F.when(F.abs("estimate") >= 0.01, pct_change(F.col("actual"), F.col("estimate")))
    return eps.where("estimate is not null").select("ticker", "period", "actual", "estimate", delta.alias("delta"), pct.alias("surprise_pct"), (delta > 0).alias("beat"))


def beat_streak(eps: DataFrame) -> DataFrame:
    """How many of the latest quarters beat without a miss, the rate of beats and its signal."""
    newest = Window.partitionBy("ticker").orderBy(F.col("period").desc())
    misses = F.sum((~F.col("beat")).cast("int")).over(newest)
    rows = surprises(eps).withColumn("misses", misses)
    out = rows.groupBy("ticker").agg(F.count_if(F.col("misses") == 0).alias("streak"), F.count_if("beat").alias("beats"), F.count("*").alias("n"))
    rate = F.col("beats") / F.col("n")
    return out.withColumn("beat_rate", rate).withColumn("surprise_signal", ladders.surprise_signal(rate))


def momentum(eps: DataFrame) -> DataFrame:
    """Revision of the newest estimate and growth of the newest actual, with their classes together."""
    newest = Window.partitionBy("ticker").orderBy(F.col("period").desc())
    rows = eps.withColumn("rn", F.row_number().over(newest))
    at = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    out = rows.groupBy("ticker").agg(at("estimate", 1).alias("estimate"), at("estimate", 2).alias("estimate_before"), at("actual", 1).alias("actual"), at("actual", 5).alias("year_ago"))
    revision, growth = pct_change(F.col("estimate"), F.col("estimate_before")), pct_change(F.col("actual"), F.col("year_ago"))
    out = out.withColumn("revision_pct", revision).withColumn("growth_pct", growth)
    out = out.withColumn("revision", ladders.revision_direction(F.col("revision_pct"))).withColumn("momentum", F.coalesce(ladders.momentum_flag(F.col("growth_pct")), F.lit("NO_HISTORY")))
    strong = F.col("momentum").isin("STRONG", "POSITIVE")
    both = F.when((F.col("revision") == "UPGRADING") & strong, "POSITIVE_CONFIRMED").when((F.col("revision") == "DOWNGRADING") & ~strong, "NEGATIVE_CONFIRMED").when(F.col("revision") == "UPGRADING", "MIXED_POSITIVE_REVISION").when(F.col("revision") == "DOWNGRADING", "MIXED_NEGATIVE_REVISION").when(strong, "STABLE_POSITIVE").otherwise("STABLE_NEGATIVE")
    return out.select("ticker", "revision_pct", "growth_pct", "revision", "momentum", both.alias("composite"))


def estimate_match(actuals: DataFrame, estimates: DataFrame) -> DataFrame:
    """Each actual with the first estimate whose period label or date is the same; the label goes first.

    The OR of two equalities is taken apart into two equi-joins.
    """
    by_label = actuals.join(estimates.select("ticker", "label", F.col("estimate").alias("by_label")), ["ticker", "label"], "left")
    dated = estimates.select("ticker", F.col("period_end").alias("period"), F.col("estimate").alias("by_date"))
    both = by_label.join(dated, ["ticker", "period"], "left")
    status = F.when(F.col("by_label").isNotNull(), "MATCHED").when(F.col("by_date").isNotNull(), "UNVERIFIED").otherwise("INCOMPLETE")
    return both.select("ticker", "period", "label", "actual", F.coalesce("by_label", "by_date").alias("estimate"), status.alias("alignment"))


def calendar_page(events: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    """A page of a calendar, one row beyond the limit telling whether there is more."""
    page = events.orderBy(*order).offset(offset).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(*order))  # at most limit + 1 rows
    rows = page.withColumn("position", n)
    more = F.max("position").over(Window.partitionBy()) > limit
    return rows.withColumn("has_more", more).where(F.col("position") <= limit)


def target_position(quotes: DataFrame, targets: DataFrame) -> DataFrame:
    """The price as a share of the mean target, with bracket and tag."""
    pct = F.try_divide("close", "target") * 100
    out = quotes.join(targets, "ticker", "left").withColumn("pct_of_target", pct)
    return out.select("ticker", "close", "target", "pct_of_target", ladders.target_bracket(F.col("pct_of_target")).alias("bracket"), ladders.target_tag(F.col("pct_of_target")).alias("tag"))


def position_inputs(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables keyed by ticker side by side, with the names of those that have no row."""
    out = None
    for name, part in parts.items():
        marked = part.withColumn(f"has_{name}", F.lit(True))
        out = marked if out is None else out.join(marked, "ticker", "full")
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(f"has_{n}").isNull(), n) for n in parts]), lambda x: x.isNotNull()), ",")
    return out.withColumn("missing", missing).drop(*[f"has_{n}" for n in parts])
