"""Classification ladders: the first threshold that is met gives the class; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, rungs: list[tuple[str, float, str]], otherwise: str | None) -> Column:
    """``rungs`` are (comparison, threshold, class); a null value has no class."""
    compare = {">": value.__gt__, ">=": value.__ge__, "<": value.__lt__, "<=": value.__le__}
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for sign, threshold, name in rungs:
        out = out.when(compare[sign](threshold), name)
    return out.otherwise(otherwise)


def volume_flag(ratio: Column) -> Column:
    return ladder(ratio, [(">", 1.5, "HIGH"), ("<", 0.7, "LOW")], "NORMAL")


def slope_direction(pct: Column) -> Column:
    return F.coalesce(ladder(pct, [(">=", 0.5, "UP"), ("<=", -0.5, "DOWN")], "FLAT"), F.lit("FLAT"))


def gap_direction(pct: Column) -> Column:
    return ladder(pct, [(">", 0.1, "UP"), ("<", -0.1, "DOWN")], "FLAT")


def trend(pct_50: Column, pct_200: Column) -> Column:
    both = pct_50.isNotNull() & pct_200.isNotNull()
    return F.when(both & (pct_50 >= 0) & (pct_200 >= 0), "BULLISH").when(both & (pct_50 < 0) & (pct_200 < 0), "BEARISH").when(both, "MIXED")


def debt_tier(ratio: Column) -> Column:
    return ladder(ratio, [("<", 1, "CLEAN"), ("<=", 2.5, "MODERATE"), ("<=", 4, "ELEVATED")], "STRESSED")


def revision_direction(pct: Column) -> Column:
    return ladder(pct, [(">=", 3, "UPGRADING"), ("<=", -3, "DOWNGRADING")], "STABLE")


def momentum_flag(pct: Column) -> Column:
    return ladder(pct, [(">", 10, "STRONG"), (">=", 0, "POSITIVE"), (">", -10, "NEGATIVE")], "COLLAPSING")


def surprise_signal(beat_rate: Column) -> Column:
    return ladder(beat_rate, [(">=", 0.75, "STRONG"), (">=", 0.55, "POSITIVE"), (">=", 0.40, "NEUTRAL")], "NEGATIVE")


def target_bracket(pct_of_target: Column) -> Column:
    return ladder(pct_of_target, [("<=", 75, "STRONG_BUY"), ("<=", 90, "ACCEPTABLE"), ("<=", 100, "CAUTION")], "AVOID")


def target_tag(pct_of_target: Column) -> Column:
    return ladder(pct_of_target, [("<", 40, "SPECULATIVE"), ("<", 80, "LONG"), ("<", 100, "NEAR")], "INVERTED")


def put_volume_trend(ratio: Column) -> Column:
    return ladder(ratio, [(">", 1.1, "INCREASING"), ("<", 0.9, "DECREASING")], "STABLE")


def freshness(age_hours: Column, is_weekend: Column, is_friday_data: Column) -> Column:
    return (
        F.when(age_hours < 0, "UNKNOWN")
        .when(is_weekend & is_friday_data & (age_hours <= 72), "WEEKEND_EXPECTED_STALE")
        .when(age_hours <= 28, "FRESH")
        .when(age_hours <= 56, "MARKET_CLOSED_EXPECTED_STALE")
        .when(age_hours <= 168, "STALE")
        .otherwise("VERY_STALE")
    )


def target_lag(target: Column, price: Column, upgrades: Column) -> Column:
    """Whether a consensus target under the price lags behind upgrades of the last month."""
    known = target.isNotNull() & price.isNotNull()
    return F.when(~known, "UNKNOWN").when(target >= price, "CURRENT").when(upgrades > 0, "LIKELY_STALE_OR_LAGGING").otherwise("POSSIBLY_STALE")


def forward_revision(pct_7: Column, pct_30: Column, pct_90: Column) -> tuple[Column, Column]:
    """The signal of the estimates' revisions and what it rests on: 30 days (7 if those are neutral), else 7, else 90."""
    month, week, season = (F.coalesce(ladder(p, [("<=", -3, "NEGATIVE"), (">=", 3, "POSITIVE")], "NEUTRAL"), F.lit("UNKNOWN")) for p in (pct_30, pct_7, pct_90))
    by_week = (month == "NEUTRAL") & week.isin("NEGATIVE", "POSITIVE")
    signal = F.when(by_week, week).when(month != "UNKNOWN", month).when(week != "UNKNOWN", week).otherwise(season)
    driver = F.when(by_week, "30d_neutral_7d").when(pct_30.isNotNull(), "30d").when(pct_7.isNotNull(), "7d").when(pct_90.isNotNull(), "90d_fallback").otherwise("none")
    return signal, driver


def overnight_stale(session: Column, age_hours: Column, hours_since_end: Column) -> Column:
    """An active session is stale after two hours, an ended one twelve hours after its end, any other always."""
    return F.coalesce(F.when(session == "ACTIVE", age_hours > 2).when(session == "ENDED", hours_since_end > 12), F.lit(True))


def release_coverage(has_exhibit: Column, has_page: Column, without_exhibit: Column, releases: Column) -> Column:
    """The best official source of releases that was met."""
    return F.when(has_exhibit, "SEC_EX99_RESOLVED").when(has_page, "APPROVED_IR_PAGE_RESOLVED").when(without_exhibit > 0, "SEC_8K_FOUND_EX99_NOT_FOUND").when(releases > 0, "OFFICIAL_RELEASE_SOURCE_FOUND").otherwise("NO_OFFICIAL_RELEASE_SOURCE")


def exposure_overall(revenue_status: Column, other_found: Column) -> Column:
    """Revenue exposure first, then any other evidence, then why there is none."""
    return F.when(revenue_status == "FOUND_REVENUE_EXPOSURE", revenue_status).when(other_found, "FOUND_NON_REVENUE_EXPOSURE").when(revenue_status.isin("NOT_DISCLOSED", "CONFLICTING"), revenue_status).otherwise("NOT_FOUND")


def table_unit(text: Column) -> Column:
    """The largest unit that a table or the text before it names."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    named = [F.when(F.contains(plain, F.lit(unit)), f"{unit}s") for unit in ("billion", "million", "thousand")]
    return F.coalesce(*named, F.lit("unknown"))


def table_confidence(has_years: Column, has_labels: Column, unit: Column) -> Column:
    return F.when(has_years & has_labels & (unit != "unknown"), "HIGH").when(has_years | has_labels, "MEDIUM").otherwise("LOW")
