"""Statement analytics over long statements (ticker, period, line_item, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ladders


def pivot_statement(statements: DataFrame, items: list[str]) -> DataFrame:
    """One row per ticker and period with a column per line item (named in snake case)."""
    wide = statements.groupBy("ticker", "period").pivot("line_item", items).agg(F.max("value"))
    return wide.withColumnsRenamed({i: i.lower().replace(" ", "_") for i in items})


def unpivot_statement(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Back to long form, without missing values."""
    return wide.unpivot(["ticker", "period"], columns, "line_item", "value").where("value is not null")


def ttm(statements: DataFrame, quarters: int = 4) -> DataFrame:
    """For each line item the sum of its latest four non-null quarters, and how many there were."""
    newest = Window.partitionBy("ticker", "line_item").orderBy(F.col("period").desc())
    rows = statements.where("value is not null").withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= quarters)
    total = F.sum(F.col("value").cast("decimal(28,4)")).cast("double")
    return rows.groupBy("ticker", "line_item").agg(total.alias("ttm"), F.count("*").alias("n_quarters"), F.max("period").alias("latest"))


def line_item_fallback(statements: DataFrame, names: list[str], quarters: int = 4) -> DataFrame:
    """The first of several names that has any value in the latest calendar quarters, summed over them."""
    newest = F.dense_rank().over(Window.partitionBy("ticker").orderBy(F.col("period").desc()))
    recent = statements.withColumn("q", newest).where(F.col("q") <= quarters)
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("line_item"))
    sums = recent.where(F.col("line_item").isin(names)).groupBy("ticker", "line_item", order.alias("place")).agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("total"), F.count("*").alias("n_quarters"))
    best = F.row_number().over(Window.partitionBy("ticker").orderBy("place"))
    chosen = sums.withColumn("rn", best).where("rn = 1").select("ticker", F.col("line_item").alias("source_row"), "total", "n_quarters")
    return statements.select("ticker").distinct().join(chosen, "ticker", "left")


def _positive_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b))


def credit_health(statements: DataFrame, balances: DataFrame) -> DataFrame:
    """Leverage and coverage from trailing sums: provider EBITDA against operating income plus depreciation."""
    sums = ttm(statements)
    wide = sums.groupBy("ticker").pivot("line_item", ["Interest Expense", "Operating Income", "Reconciled Depreciation", "EBITDA"]).agg(F.max("ttm"))
    names = {"Interest Expense": "interest", "Operating Income": "ebit", "Reconciled Depreciation": "depreciation", "EBITDA": "provider_ebitda"}
    out = wide.withColumnsRenamed(names).join(balances, "ticker", "left").withColumn("interest", F.abs("interest"))
    operating = F.col("ebit") + F.col("depreciation")
    out = out.withColumn("operating_ebitda", operating).withColumn("ebitda", F.coalesce("operating_ebitda", "provider_ebitda"))
    out = out.withColumn("ebitda_source", F.when(F.col("operating_ebitda").isNotNull(), "operating").when(F.col("provider_ebitda").isNotNull(), "provider_ebitda_fallback"))
    debt = F.col("total_debt") - F.coalesce("cash", F.lit(0.0))
    out = out.withColumn("net_debt", debt).withColumn("net_debt_to_ebitda", _positive_ratio(F.col("net_debt"), F.col("ebitda")))
    out = out.withColumn("coverage_ebit", _positive_ratio(F.col("ebit"), F.col("interest"))).withColumn("coverage_ebitda", _positive_ratio(F.col("ebitda"), F.col("interest")))
    gap = F.abs(F.col("provider_ebitda") - F.col("operating_ebitda"))
    diverges = (F.try_divide(gap, F.greatest(F.abs("operating_ebitda"), F.lit(1.0))) >= 0.25) & (gap >= 100_000_000)
    stress = (F.col("net_debt_to_ebitda") > 2.5) & (F.col("coverage_ebit") < 3)
    return out.withColumn("ebitda_divergence", diverges).withColumn("credit_stress", stress).withColumn("debt_tier", ladders.debt_tier(F.col("net_debt_to_ebitda")))


def interest_anomaly(statements: DataFrame, times: float = 2.0) -> DataFrame:
    """Whether the latest quarter's interest is over twice the mean of the three before."""
    newest = Window.partitionBy("ticker").orderBy(F.col("period").desc())
    rows = statements.where("line_item = 'Interest Expense'").withColumn("rn", F.row_number().over(newest)).where("rn <= 4")
    value = F.abs("value")
    out = rows.groupBy("ticker").agg(F.max(F.when(F.col("rn") == 1, value)).alias("latest"), F.sum(F.when(F.col("rn") > 1, value.cast("decimal(28,4)"))).cast("double").alias("total"), F.count_if(F.col("rn") > 1).alias("n_prior"))
    prior = F.try_divide(F.col("total"), F.col("n_prior"))
    return out.select("ticker", "latest", prior.alias("prior_avg"), (F.col("latest") > times * prior).alias("anomaly"))


def financial_ratios(statements: DataFrame, balances: DataFrame) -> DataFrame:
    """Margins and turnover of each period, and growth on the period a year before."""
    wide = pivot_statement(statements, ["Total Revenue", "Operating Income", "EBITDA", "Interest Expense"])
    year_ago = F.lag("total_revenue", 4).over(Window.partitionBy("ticker").orderBy("period"))
    rows = wide.withColumn("revenue_year_ago", year_ago).join(balances, "ticker", "left")
    return rows.select(
        "ticker",
        "period",
        F.try_divide("operating_income", "total_revenue").alias("operating_margin"),
        F.try_divide("ebitda", "total_revenue").alias("ebitda_margin"),
        F.try_divide("interest_expense", "operating_income").alias("interest_burden"),
        F.try_divide("total_debt", "total_revenue").alias("debt_to_revenue"),
        (F.try_divide(F.col("total_revenue") - F.col("revenue_year_ago"), F.abs("revenue_year_ago")) * 100).alias("revenue_growth_pct"),
    )


#: Suffix and its multiplier.
SUFFIXES = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}


def parse_suffixed(text: Column) -> Column:
    """A number such as ``1,234.5M`` or ``3.2B`` as a double; null if it is none."""
    plain = F.upper(F.trim(F.regexp_replace(text, "[,$ ]", "")))
    number = F.try_to_number(F.regexp_extract(plain, "^(-?[0-9]+([.][0-9]+)?)[KMBT]?$", 1), F.lit("S999999999999.999999"))
    factor = F.coalesce(*[F.when(plain.endswith(s), f) for s, f in SUFFIXES.items()], F.lit(1.0))
    return number.cast("double") * factor


def compact_shares(shares: DataFrame) -> DataFrame:
    """The last count of each day, then only the days on which it changed."""
    daily = shares.groupBy("ticker", "d").agg(F.max_by("shares", "seq").alias("shares"))
    before = F.lag("shares").over(Window.partitionBy("ticker").orderBy("d"))
    return daily.withColumn("before", before).where(~F.col("shares").eqNullSafe(F.col("before")) | F.col("before").isNull()).select("ticker", "d", "shares")


def share_trend(shares: DataFrame) -> DataFrame:
    """First and current count, the change in percent and the number of samples after compaction."""
    rows = compact_shares(shares)
    out = rows.groupBy("ticker").agg(F.min_by("shares", "d").alias("first_shares"), F.max_by("shares", "d").alias("current_shares"), F.count("*").alias("n_samples"))
    return out.withColumn("change_pct", F.try_divide(F.col("current_shares") - F.col("first_shares"), F.nullif(F.col("first_shares"), F.lit(0))) * 100)
