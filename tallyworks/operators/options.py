"""Option-chain analytics over contracts (ticker, expiration, kind, strike, bid, ask, volume, open_interest, iv, last_trade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ladders

CHAIN = ["ticker", "expiration"]
PLACEHOLDER_IV = 0.0001


def near_money(contracts: DataFrame, spot: DataFrame, width: float = 0.2) -> DataFrame:
    """Contracts whose strike is within a share of the spot price (ticker, spot), marked in or out of the money."""
    joined = contracts.join(spot, "ticker").where(F.col("strike").between(F.col("spot") * (1 - width), F.col("spot") * (1 + width)))
    return joined.withColumn("in_the_money", in_the_money())


def in_the_money() -> Column:
    return F.when(F.col("kind") == "call", F.col("strike") < F.col("spot")).otherwise(F.col("strike") > F.col("spot"))


def liquid(contracts: DataFrame, least_open_interest: int = 0, least_volume: int = 0) -> DataFrame:
    """Contracts with any quote or open interest; floors hold only if they are above 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = contracts.where((z("bid") > 0) | (z("ask") > 0) | (z("open_interest") > 0))
    if least_open_interest > 0:
        out = out.where(z("open_interest") >= least_open_interest)
    return out.where(z("volume") >= least_volume) if least_volume > 0 else out


def chain_quality(contracts: DataFrame, as_of: str, stale_days: int = 7) -> DataFrame:
    """Shares of unquoted, unheld, placeholder and stale contracts of each chain, and its class."""
    bad = {
        "zero_quote": (F.col("bid") <= 0) & (F.col("ask") <= 0),
        "zero_oi": F.col("open_interest") <= 0,
        "placeholder_iv": F.col("iv") <= PLACEHOLDER_IV,
        "stale": F.datediff(F.lit(as_of).cast("date"), "last_trade") > stale_days,
    }
    rows = contracts.groupBy(*CHAIN).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in bad.items()])
    share = {k: F.col(f"n_{k}") / F.col("n") for k in bad}
    worse = (share["zero_quote"] > 0.5) | (share["zero_oi"] > 0.8) | (share["placeholder_iv"] > 0.5) | (share["stale"] > 0.5)
    middling = (share["zero_quote"] > 0.3) | (share["zero_oi"] > 0.5) | (share["placeholder_iv"] > 0.3) | (share["stale"] > 0.3)
    warnings = F.array_join(F.filter(F.array(*[F.when(share[k] > 0.5, k) for k in bad]), lambda x: x.isNotNull()), ",")
    return rows.withColumn("quality", F.when(worse, "LOW").when(middling, "MEDIUM").otherwise("HIGH")).withColumn("warnings", warnings)


def most_relevant(contracts: DataFrame, spot: DataFrame, limit: int = 50) -> DataFrame:
    """The first contracts of each chain by quote, liquidity, IV, distance to the spot, open interest, volume and spread."""
    rows = contracts.join(spot, "ticker", "left")
    quoted = ((F.col("bid") > 0) & (F.col("ask") > 0)).cast("int")
    live = ((F.col("open_interest") > 0) | (F.col("volume") > 0)).cast("int")
    spread = F.when(quoted == 1, F.col("ask") - F.col("bid")).otherwise(9999.0)
    keys = [quoted.desc(), live.desc(), (F.col("iv") > PLACEHOLDER_IV).cast("int").desc(), F.abs(F.col("strike") - F.col("spot")).asc_nulls_last(), F.col("open_interest").desc(), F.col("volume").desc(), spread.asc(), F.col("kind"), F.col("strike")]
    rank = F.row_number().over(Window.partitionBy(*CHAIN).orderBy(*keys))
    return rows.withColumn("relevance", rank).where(F.col("relevance") <= limit).select(*CHAIN, "kind", "strike", "relevance")


def put_call(contracts: DataFrame) -> DataFrame:
    """Put and call sums and their ratios for each chain."""
    side = lambda k, c: F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0))
    rows = contracts.groupBy(*CHAIN).agg(*[side(k, c).alias(f"{k}_{c}") for c in ("volume", "open_interest") for k in ("put", "call")])
    return rows.withColumn("pc_volume", F.try_divide("put_volume", "call_volume")).withColumn("pc_open_interest", F.try_divide("put_open_interest", "call_open_interest"))


def atm_iv(contracts: DataFrame, spot: DataFrame) -> DataFrame:
    """The IV of each side's strike nearest to the spot (the lower one of two as near)."""
    rows = contracts.join(spot, "ticker")
    near = lambda k: F.min_by("iv", F.when(F.col("kind") == k, F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))))
    return rows.groupBy(*CHAIN).agg(near("call").alias("call_iv"), near("put").alias("put_iv"), F.first("spot").alias("spot"))


def max_pain(contracts: DataFrame) -> DataFrame:
    """The strike at which all holders together would receive least; the lowest of equal ones.

    Payouts are running sums over the ordered strikes, so no strike meets every contract.
    """
    sums = contracts.groupBy(*CHAIN, "strike").agg(*[F.sum(F.when(F.col("kind") == k, F.col("open_interest")).otherwise(0)).alias(k) for k in ("call", "put")])
    below = Window.partitionBy(*CHAIN).orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*CHAIN).orderBy("strike").rowsBetween(0, Window.unboundedFollowing)
    calls = F.col("strike") * F.sum("call").over(below) - F.sum(F.col("call") * F.col("strike")).over(below)
    puts = F.sum(F.col("put") * F.col("strike")).over(above) - F.col("strike") * F.sum("put").over(above)
    return sums.withColumn("payout", calls + puts).groupBy(*CHAIN).agg(F.min_by("strike", F.struct("payout", "strike")).alias("max_pain"), F.min("payout").alias("payout"), F.count("*").alias("n_strikes"))


def most_open_interest(contracts: DataFrame) -> DataFrame:
    """The other meaning of max pain: the strike with most open interest, the lowest of equal ones."""
    sums = contracts.groupBy(*CHAIN, "strike").agg(F.sum("open_interest").alias("open_interest"))
    return sums.groupBy(*CHAIN).agg(F.max_by("strike", F.struct("open_interest", -F.col("strike"))).alias("max_oi_strike"), F.max("open_interest").alias("open_interest"))


def put_hedges(contracts: DataFrame, spot: DataFrame, low: float = 0.05, high: float = 0.15) -> DataFrame:
    """Quoted puts out of the money by a share, of each ticker's two nearest expirations, with their cost."""
    puts = contracts.where("kind = 'put'").join(spot, "ticker")
    nearest = F.dense_rank().over(Window.partitionBy("ticker").orderBy("expiration"))
    out = (F.col("spot") - F.col("strike")) / F.col("spot")
    mid = F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("bid") + F.col("ask")) / 2)
    rows = puts.withColumn("n", nearest).where("n <= 2").withColumn("otm_pct", out).withColumn("mid", mid)
    return rows.where(F.col("otm_pct").between(low, high) & F.col("mid").isNotNull()).select("ticker", "expiration", "strike", "mid", "otm_pct", F.try_divide(F.col("mid"), F.col("spot")).alias("cost_pct"))


def iv_percentile(contracts: DataFrame) -> DataFrame:
    """The share of a ticker's contracts with an IV at or below; contracts without IV count, but have none."""
    every = Window.partitionBy("ticker")
    upto = every.orderBy("iv").rangeBetween(Window.unboundedPreceding, 0)
    positive = F.sum((F.col("iv") > 0).cast("int")).over(upto)
    share = F.when(F.col("iv") > 0, positive / F.count("*").over(every))
    return contracts.select("ticker", "expiration", "kind", "strike", "iv", share.alias("iv_percentile"))


def nearest_expiry(contracts: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (ticker, wanted date) the expiration fewest days away, the earlier of two as near."""
    dates = contracts.select(*CHAIN).distinct()
    days = F.abs(F.datediff("expiration", "wanted"))
    return wanted.join(dates, "ticker").groupBy("ticker", "wanted").agg(F.min_by("expiration", F.struct(days, "expiration")).alias("expiration"), F.min(days).alias("days_off"))


def flow_bracket(contracts: DataFrame, as_of: str) -> DataFrame:
    """Where in its range a price may end, from put/call volume, the trend of put volume and chain quality."""
    flow = put_call(contracts).join(chain_quality(contracts, as_of).select(*CHAIN, "quality"), CHAIN)
    before = F.lag("put_volume").over(Window.partitionBy("ticker").orderBy("expiration"))
    trend = ladders.put_volume_trend(F.try_divide(F.col("put_volume"), F.nullif(before, F.lit(0))))
    rows = flow.withColumn("put_trend", trend)
    pc, rising = F.col("pc_volume"), F.coalesce(F.col("put_trend") == "INCREASING", F.lit(False))
    bracket = F.when((F.col("quality") == "LOW") | pc.isNull(), F.lit(None)).when((pc >= 1.3) | ((pc >= 1.0) & rising), "UPPER").when((pc <= 0.8) & ~rising, "LOWER").otherwise("MID")
    return rows.select(*CHAIN, "pc_volume", "put_trend", "quality", bracket.alias("bracket"))
