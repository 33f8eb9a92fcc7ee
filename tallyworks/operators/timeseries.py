"""Technical indicators over daily bars (ticker, d, open, high, low, close, adj_close, volume).

Every function partitions by ticker, orders by date, and stays lazy. Sums are
taken over decimals, so that they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import ladders



def by_date() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("d")


def newest() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy(F.col("d").desc())


def mean_over(value: str, rows: int) -> Column:
    """The mean of the last ``rows`` values, null while there are fewer."""
    frame = by_date().rowsBetween(1 - rows, 0)
    total = F.sum(F.col(value).cast("decimal(18,6)")).over(frame).cast("double")
    return F.when(F.count(value).over(frame) == rows, total / rows)


def latest(bars: DataFrame) -> DataFrame:
    return bars.withColumn("rn", F.row_number().over(newest())).where("rn = 1").drop("rn")


def daily_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(by_date())
    return bars.select("ticker", "d", "close", (F.try_divide(F.col("close"), before) - 1).alias("ret"), F.try_divide(F.col("open") - before, before).alias("gap")).withColumn("gap_direction", ladders.gap_direction(F.col("gap") * 100))


def moving_averages(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", "d", "close", mean_over("close", 50).alias("sma_50"), mean_over("close", 200).alias("sma_200"))


def sma_position(bars: DataFrame) -> DataFrame:
    """The last close against its moving averages, with the trend."""
    last = latest(moving_averages(bars))
    pct = {n: F.try_divide(F.col("close") - F.col(f"sma_{n}"), F.col(f"sma_{n}")) * 100 for n in (50, 200)}
    out = last.withColumn("pct_50", pct[50]).withColumn("pct_200", pct[200])
    side = {n: F.when(F.col(f"pct_{n}") >= 0, "ABOVE").when(F.col(f"pct_{n}") < 0, "BELOW").alias(f"side_{n}") for n in (50, 200)}
    return out.select("*", side[50], side[200], ladders.trend(F.col("pct_50"), F.col("pct_200")).alias("trend"))


def realized_volatility(bars: DataFrame, days: int = 30, least: int = 20) -> DataFrame:
    """Annualised sample deviation of the last daily returns, null with fewer than ``least``."""
    rows = daily_returns(bars).where("ret is not null").withColumn("rn", F.row_number().over(newest())).where(F.col("rn") <= days)
    vol = F.round(F.stddev_samp("ret") * F.sqrt(F.lit(252.0)), 6)
    return rows.groupBy("ticker").agg(F.count("*").alias("n_returns"), F.when(F.count("*") >= least, vol).alias("vol"))


def rolling_volatility(bars: DataFrame, days: int = 30) -> DataFrame:
    frame = by_date().rowsBetween(1 - days, 0)
    vol = F.round(F.stddev_samp("ret").over(frame) * F.sqrt(F.lit(252.0)), 6)
    rows = daily_returns(bars)
    return rows.select("ticker", "d", F.when(F.count("ret").over(frame) == days, vol).alias("vol")).where("vol is not null")


def volatility_rank(bars: DataFrame) -> DataFrame:
    """The last rolling volatility between the least and the greatest of the series, and its share of values at or below."""
    series = rolling_volatility(bars)
    last = series.groupBy("ticker").agg(F.max_by("vol", "d").alias("vol"), F.min("vol").alias("low"), F.max("vol").alias("high"), F.count("*").alias("n"))
    at_most = series.join(last.select("ticker", F.col("vol").alias("last_vol")), "ticker").groupBy("ticker").agg(F.count_if(F.col("vol") <= F.col("last_vol")).alias("below"))
    rank = F.try_divide(F.col("vol") - F.col("low"), F.col("high") - F.col("low"))
    return last.join(at_most, "ticker").select("ticker", "vol", F.least(F.lit(1.0), F.greatest(F.lit(0.0), rank)).alias("iv_rank"), (F.col("below") / F.col("n")).alias("vol_percentile"))


def _ordered_closes(bars: DataFrame) -> DataFrame:
    closes = F.sort_array(F.collect_list(F.struct("d", "close")))
    return bars.groupBy("ticker").agg(closes.alias("series"))


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Wilder's RSI of the last bar: exponential means with weight 1/period from a first change of 0."""
    w = 1.0 / period
    begin = F.struct(F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"), F.lit(None).cast("double").alias("close"))

    def step(s: Column, bar: Column) -> Column:
        change = bar["close"] - s["close"]
        first = s["close"].isNull()
        gain, loss = F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))
        mean = lambda old, new: F.when(first, F.lit(0.0)).otherwise(old * (1 - w) + new * w)
        return F.struct(mean(s["gain"], gain).alias("gain"), mean(s["loss"], loss).alias("loss"), bar["close"].alias("close"))

    folded = _ordered_closes(bars).select("ticker", F.size("series").alias("n"), F.aggregate("series", begin, step).alias("s"))
    rs = F.try_divide(F.col("s.gain"), F.col("s.loss"))
    value = F.when(F.col("s.loss") > 0, 100 - 100 / (1 + rs)).when(F.col("s.gain") > 0, 100.0)
    return folded.select("ticker", F.col("n").cast("long").alias("n_bars"), F.when(F.col("n") >= period, value).alias("rsi_14"))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, signal and histogram of the last bar; null with fewer than ``slow`` bars."""
    wf, ws, wl = (2.0 / (n + 1) for n in (fast, slow, signal))
    nothing = F.lit(None).cast("double")
    begin = F.struct(nothing.alias("fast"), nothing.alias("slow"), nothing.alias("line"), nothing.alias("signal"))

    def step(s: Column, bar: Column) -> Column:
        mean = lambda old, new, w: F.when(old.isNull(), new).otherwise(old * (1 - w) + new * w)
        fast_now, slow_now = mean(s["fast"], bar["close"], wf), mean(s["slow"], bar["close"], ws)
        line = fast_now - slow_now
        return F.struct(fast_now.alias("fast"), slow_now.alias("slow"), line.alias("line"), mean(s["signal"], line, wl).alias("signal"))

    folded = _ordered_closes(bars).select("ticker", F.size("series").alias("n"), F.aggregate("series", begin, step).alias("s")).where(F.col("n") >= slow)
    return folded.select("ticker", F.col("s.line").alias("macd"), F.col("s.signal").alias("macd_signal"), (F.col("s.line") - F.col("s.signal")).alias("macd_histogram"))


def price_slope(bars: DataFrame, days: int = 10) -> DataFrame:
    """The adjusted close against that of the first of the last ``days`` bars, in percent, with its direction."""
    rows = bars.withColumn("rn", F.row_number().over(newest())).where(F.col("rn") <= days)
    ends = rows.groupBy("ticker").agg(F.min_by("adj_close", "d").alias("first_adj"), F.max_by("adj_close", "d").alias("last_adj"), F.max_by("close", "d").alias("last_close"), F.count("*").alias("n_bars"))
    pct = F.try_divide(F.col("last_adj") - F.col("first_adj"), F.col("first_adj")) * 100
    return ends.withColumn("slope_pct", pct).withColumn("direction", ladders.slope_direction(F.col("slope_pct")))


def cagr(bars: DataFrame, years: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Compound growth from the first bar of each calendar window to the last; the exponent is the nominal span."""
    end = F.max("d").over(Window.partitionBy("ticker"))
    rows = bars.withColumn("end", end)
    aggs = [F.max_by("close", "d").alias("last_close")]
    for y in years:
        inside = F.col("d") >= F.add_months("end", -12 * y)
        aggs += [F.min_by("close", F.when(inside, F.col("d"))).alias(f"first_{y}y"), F.count_if(inside).alias(f"n_{y}y")]
    out = rows.groupBy("ticker").agg(*aggs)
    growth = [F.when((F.col(f"n_{y}y") >= 2) & (F.col(f"first_{y}y") > 0), F.round((F.pow(F.try_divide(F.col("last_close"), F.col(f"first_{y}y")), F.lit(1.0 / y)) - 1) * 100, 6)).alias(f"cagr_{y}y") for y in years]
    return out.select("ticker", *growth)


def range_52w(bars: DataFrame) -> DataFrame:
    """The last close against the high and low of the 365 days before."""
    end = F.max("d").over(Window.partitionBy("ticker"))
    rows = bars.withColumn("end", end).where(F.col("d") >= F.date_sub("end", 365))
    out = rows.groupBy("ticker").agg(F.max("high").alias("high_52w"), F.min("low").alias("low_52w"), F.max_by("close", "d").alias("close"))
    return out.withColumn("pct_from_high", F.try_divide(F.col("close") - F.col("high_52w"), F.col("high_52w")) * 100).withColumn("pct_from_low", F.try_divide(F.col("close") - F.col("low_52w"), F.col("low_52w")) * 100)


def volume_ratio(bars: DataFrame) -> DataFrame:
    """The last volume against its 10- and 63-day means, with a flag; 0 counts as missing."""
    last = latest(bars.select("ticker", "d", "volume", mean_over("volume", 10).alias("avg_10"), mean_over("volume", 63).alias("avg_63")))
    ratio = {n: F.try_divide(F.nullif(F.col("volume"), F.lit(0)), F.nullif(F.col(f"avg_{n}"), F.lit(0.0))) for n in (10, 63)}
    return last.select("ticker", "d", "volume", "avg_10", "avg_63", ratio[10].alias("ratio_10"), ratio[63].alias("ratio_63"), ladders.volume_flag(ratio[10]).alias("volume_flag"))


def volume_gate(bars: DataFrame, days: int = 20, least: float = 0.5) -> DataFrame:
    """Whether the last volume is at least half the mean of the last 20."""
    last = latest(bars.select("ticker", "d", "volume", mean_over("volume", days).alias("avg_volume")))
    ratio = F.try_divide(F.col("volume"), F.col("avg_volume"))
    return last.select("ticker", "d", ratio.alias("ratio"), (ratio >= least).alias("gate_pass"))


def notional_gate(bars: DataFrame, currency: DataFrame, rates: DataFrame, least: float) -> DataFrame:
    """The last bar's notional value in the common currency against a floor; an unknown rate counts as 1."""
    last = latest(bars.select("ticker", "d", "close", "volume"))
    priced = last.join(currency, "ticker", "left").join(rates, "currency", "left")
    notional = F.col("close") * F.col("volume") * F.coalesce("rate", F.lit(1.0))
    return priced.select("ticker", "currency", notional.alias("notional"), (notional >= least).alias("gate_pass"))


def overnight_bars(ticks: DataFrame, zone: str = "America/New_York", start: int = 20, end: int = 4) -> DataFrame:
    """Bars of the session between two local hours, dated by the evening it starts: (ticker, ts, price) in, one row a session out."""
    local = F.from_utc_timestamp("ts", zone)
    hour = F.hour("local")
    rows = ticks.withColumn("local", local).where((hour >= start) | (hour < end))
    session = F.when(hour < end, F.date_sub(F.to_date("local"), 1)).otherwise(F.to_date("local"))
    seq = F.struct("ts", "seq")
    out = rows.withColumn("session", session).groupBy("ticker", "session").agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.count("*").alias("n_ticks")
    )
    return out.withColumn("change_pct", F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100)


def freshness(bars: DataFrame, as_of) -> DataFrame:
    """How stale each ticker's last bar is at ``as_of``, with the close at 21:00 UTC."""
    last = bars.groupBy("ticker").agg(F.max("d").alias("d"))
    hours = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("d").cast("timestamp"))) / 3600.0 - 21.0
    weekend = F.weekday(F.lit(as_of).cast("timestamp")) >= 5
    return last.select("ticker", "d", hours.alias("age_hours"), ladders.freshness(hours, weekend, F.weekday("d") == 4).alias("freshness"))


def market_snapshot(bars: DataFrame) -> DataFrame:
    """Six components by ticker in one row, with the status of each."""
    quote = latest(daily_returns(bars)).select("ticker", "d", "close", "ret")
    parts = {
        "range": range_52w(bars).select("ticker", "pct_from_high"),
        "average": sma_position(bars).select("ticker", "trend"),
        "volume": volume_ratio(bars).select("ticker", "ratio_10", "volume_flag"),
        "slope": price_slope(bars).select("ticker", "slope_pct", "direction"),
        "volatility": realized_volatility(bars).select("ticker", "vol"),
    }
    out = quote
    for part in parts.values():
        out = out.join(part, "ticker", "full")
    ok = {"range": "pct_from_high", "average": "trend", "volume": "ratio_10", "slope": "slope_pct", "volatility": "vol"}
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), k) for k, c in ok.items()]), lambda x: x.isNotNull()), ",")
    return out.withColumn("missing", missing)


def technical_indicators(bars: DataFrame) -> DataFrame:
    """RSI, MACD, moving averages, trend and last return, one row per ticker."""
    quote = latest(daily_returns(bars)).select("ticker", "d", "close", "ret")
    return quote.join(rsi(bars), "ticker").join(macd(bars), "ticker", "left").join(sma_position(bars).select("ticker", "sma_50", "sma_200", "trend"), "ticker", "left")
