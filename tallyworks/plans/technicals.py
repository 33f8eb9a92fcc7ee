"""Queries over daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as T
from ..sources import views as V
from ..sources.tables import read_table
from .registry import Group

GROUP = Group()
query = GROUP.query


def _d(x: float) -> str:
    """A double literal."""
    return f"{x!r}e0"


BARS = f"WITH {V.BARS_SQL}"
RETURNS = """
returns AS (SELECT ticker, d, close, close / nullif(lag(close) OVER w, 0) - 1 AS ret,
                   (open - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS gap
            FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d))"""


def _mean(col: str, n: int) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {frame} = {n} THEN CAST(sum(CAST({col} AS DECIMAL(18,6))) {frame} AS DOUBLE) / {n} END"


AVERAGES = f"averages AS (SELECT ticker, d, close, {_mean('close', 50)} AS sma_50, {_mean('close', 200)} AS sma_200 FROM bars)"
LAST = "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d DESC) = 1"
POSITION = f"""
position AS (
    SELECT *, CASE WHEN pct_50 >= 0 THEN 'ABOVE' WHEN pct_50 < 0 THEN 'BELOW' END AS side_50,
           CASE WHEN pct_200 >= 0 THEN 'ABOVE' WHEN pct_200 < 0 THEN 'BELOW' END AS side_200,
           CASE WHEN pct_50 IS NULL OR pct_200 IS NULL THEN NULL WHEN pct_50 >= 0 AND pct_200 >= 0 THEN 'BULLISH'
                WHEN pct_50 < 0 AND pct_200 < 0 THEN 'BEARISH' ELSE 'MIXED' END AS trend
    FROM (SELECT *, (close - sma_50) / nullif(sma_50, 0) * 100 AS pct_50, (close - sma_200) / nullif(sma_200, 0) * 100 AS pct_200
          FROM averages {LAST}))"""
VOL = """
vols AS (
    SELECT ticker, count(*) AS n_returns, CASE WHEN count(*) >= 20 THEN round(stddev_samp(ret) * sqrt(252), 6) END AS vol
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM returns WHERE ret IS NOT NULL)
    WHERE rn <= 30 GROUP BY ticker)"""
ROLLING = """
rolling AS (
    SELECT * FROM (
        SELECT ticker, d, CASE WHEN count(ret) OVER f = 30 THEN round(stddev_samp(ret) OVER f * sqrt(252), 6) END AS vol
        FROM returns WINDOW f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    WHERE vol IS NOT NULL)"""
_G = _d(1.0 / 14)
_K = _d(1 - 1.0 / 14)
RSI = f"""
changes AS (SELECT ticker, d, coalesce(greatest(close - lag(close) OVER w, 0e0), 0e0) AS gain,
                   coalesce(greatest(lag(close) OVER w - close, 0e0), 0e0) AS loss
            FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)),
folded AS (
    SELECT ticker, count(*) AS n_bars,
           list_reduce(list({{'gain': gain, 'loss': loss}} ORDER BY d),
                       lambda a, x: {{'gain': a.gain * {_K} + x.gain * {_G}, 'loss': a.loss * {_K} + x.loss * {_G}}}) AS s
    FROM changes GROUP BY ticker),
rsi AS (
    SELECT ticker, n_bars, CASE WHEN n_bars < 14 THEN NULL WHEN s.loss > 0 THEN 100 - 100 / (1 + s.gain / s.loss)
                                WHEN s.gain > 0 THEN 1e2 END AS rsi_14
    FROM folded)"""
_W = [(_d(2.0 / (n + 1)), _d(1 - 2.0 / (n + 1))) for n in (12, 26, 9)]
MACD = f"""
macd_state AS (
    SELECT ticker, count(*) AS n,
           list_reduce(list({{'f': close, 's': close, 'l': 0e0, 'g': 0e0}} ORDER BY d),
               lambda a, x: {{'f': a.f * {_W[0][1]} + x.f * {_W[0][0]}, 's': a.s * {_W[1][1]} + x.s * {_W[1][0]},
                              'l': (a.f * {_W[0][1]} + x.f * {_W[0][0]}) - (a.s * {_W[1][1]} + x.s * {_W[1][0]}),
                              'g': a.g * {_W[2][1]} + ((a.f * {_W[0][1]} + x.f * {_W[0][0]}) - (a.s * {_W[1][1]} + x.s * {_W[1][0]})) * {_W[2][0]}}}) AS s
    FROM bars GROUP BY ticker),
macd AS (SELECT ticker, s.l AS macd, s.g AS macd_signal, s.l - s.g AS macd_histogram FROM macd_state WHERE n >= 26)"""
SLOPE = """
slope AS (
    SELECT *, CASE WHEN slope_pct >= 0.5 THEN 'UP' WHEN slope_pct <= -0.5 THEN 'DOWN' ELSE 'FLAT' END AS direction
    FROM (SELECT *, (last_adj - first_adj) / nullif(first_adj, 0) * 100 AS slope_pct
          FROM (SELECT ticker, arg_min(adj_close, d) AS first_adj, arg_max(adj_close, d) AS last_adj, arg_max(close, d) AS last_close, count(*) AS n_bars
                FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn FROM bars) WHERE rn <= 10 GROUP BY ticker)))"""
RANGE = """
ranges AS (
    SELECT *, (close - high_52w) / nullif(high_52w, 0) * 100 AS pct_from_high, (close - low_52w) / nullif(low_52w, 0) * 100 AS pct_from_low
    FROM (SELECT ticker, max(high) AS high_52w, min(low) AS low_52w, arg_max(close, d) AS close
          FROM (SELECT *, max(d) OVER (PARTITION BY ticker) AS last FROM bars) WHERE d >= last - 365 GROUP BY ticker))"""
VOLUME = f"""
volumes AS (
    SELECT ticker, d, volume, avg_10, avg_63, nullif(volume, 0) / nullif(avg_10, 0) AS ratio_10, nullif(volume, 0) / nullif(avg_63, 0) AS ratio_63,
           CASE WHEN nullif(volume, 0) / nullif(avg_10, 0) IS NULL THEN NULL WHEN volume / avg_10 > 1.5 THEN 'HIGH' WHEN volume / avg_10 < 0.7 THEN 'LOW' ELSE 'NORMAL' END AS volume_flag
    FROM (SELECT ticker, d, volume, {_mean("volume", 10)} AS avg_10, {_mean("volume", 63)} AS avg_63 FROM bars {LAST}))"""


@query(f"{BARS} SELECT * FROM bars")
def ohlcv_scan(spark, sf_dir):
    return V.bars(spark, sf_dir)


@query(f"{BARS} SELECT ticker, d, close, volume FROM bars WHERE d >= DATE '1997-01-01' AND d < DATE '1998-01-01'")
def ohlcv_columns(spark, sf_dir):
    return V.bars(spark, sf_dir).where("d >= '1997-01-01' and d < '1998-01-01'").select("ticker", "d", "close", "volume")


@query(f"{BARS}, {RETURNS} SELECT *, CASE WHEN gap * 100 > 0.1 THEN 'UP' WHEN gap * 100 < -0.1 THEN 'DOWN' WHEN gap IS NOT NULL THEN 'FLAT' END AS gap_direction FROM returns")
def daily_returns(spark, sf_dir):
    return T.daily_returns(V.bars(spark, sf_dir))


@query(f"{BARS}, {AVERAGES} SELECT * FROM averages")
def moving_averages(spark, sf_dir):
    return T.moving_averages(V.bars(spark, sf_dir))


@query(f"{BARS}, {AVERAGES}, {POSITION} SELECT * FROM position")
def sma_position(spark, sf_dir):
    return T.sma_position(V.bars(spark, sf_dir))


@query(f"{BARS}, {AVERAGES}, {POSITION} SELECT trend, count(*) AS n FROM position GROUP BY trend")
def ma_trend(spark, sf_dir):
    return T.sma_position(V.bars(spark, sf_dir)).groupBy("trend").agg(F.count("*").alias("n"))


@query(f"{BARS}, {RETURNS}, {VOL} SELECT * FROM vols")
def realized_vol_30d(spark, sf_dir):
    return T.realized_volatility(V.bars(spark, sf_dir))


@query(f"{BARS}, {RETURNS}, {ROLLING} SELECT * FROM rolling")
def rolling_vol_series(spark, sf_dir):
    return T.rolling_volatility(V.bars(spark, sf_dir))


@query(f"""{BARS}, {RETURNS}, {ROLLING},
last AS (SELECT ticker, arg_max(vol, d) AS vol, min(vol) AS low, max(vol) AS high, count(*) AS n FROM rolling GROUP BY ticker)
SELECT l.ticker, l.vol, least(1e0, greatest(0e0, (l.vol - low) / nullif(high - low, 0))) AS iv_rank,
       (SELECT count(*) FROM rolling r WHERE r.ticker = l.ticker AND r.vol <= l.vol) / n AS vol_percentile
FROM last l""")
def iv_rank(spark, sf_dir):
    return T.volatility_rank(V.bars(spark, sf_dir))


@query(f"{BARS}, {RSI} SELECT * FROM rsi")
def rsi14(spark, sf_dir):
    return T.rsi(V.bars(spark, sf_dir))


@query(f"{BARS}, {MACD} SELECT * FROM macd")
def macd_12_26_9(spark, sf_dir):
    return T.macd(V.bars(spark, sf_dir))


@query(f"{BARS}, {SLOPE} SELECT * FROM slope")
def price_slope(spark, sf_dir):
    return T.price_slope(V.bars(spark, sf_dir))


@query(BARS + """, e AS (SELECT *, max(d) OVER (PARTITION BY ticker) AS last FROM bars),
g AS (SELECT ticker, arg_max(close, d) AS c, """ + ", ".join(f"arg_min(close, d) FILTER (d >= last - INTERVAL {y} YEAR) AS f{y}, count(*) FILTER (d >= last - INTERVAL {y} YEAR) AS n{y}" for y in (1, 3, 5)) + """ FROM e GROUP BY ticker)
SELECT ticker, """ + ", ".join(f"CASE WHEN n{y} >= 2 AND f{y} > 0 THEN round((pow(c / f{y}, {_d(1.0 / y)}) - 1) * 100, 6) END AS cagr_{y}y" for y in (1, 3, 5)) + " FROM g")
def cagr_1_3_5(spark, sf_dir):
    return T.cagr(V.bars(spark, sf_dir))


@query(f"{BARS}, {RANGE} SELECT * FROM ranges")
def range_52w(spark, sf_dir):
    return T.range_52w(V.bars(spark, sf_dir))


@query(f"{BARS}, {VOLUME} SELECT * FROM volumes")
def volume_ratio(spark, sf_dir):
    return T.volume_ratio(V.bars(spark, sf_dir))


@query(f"{BARS} SELECT ticker, d, volume / nullif(a, 0) AS ratio, volume / nullif(a, 0) >= 0.5 AS gate_pass FROM (SELECT ticker, d, volume, {_mean('volume', 20)} AS a FROM bars {LAST})")
def volume_gate(spark, sf_dir):
    return T.volume_gate(V.bars(spark, sf_dir))


@query(f"""{BARS},
fx AS (SELECT n_name AS currency, 1 + n_nationkey / 1e1 AS rate FROM nation WHERE n_nationkey < 20),
cur AS (SELECT DISTINCT p_brand AS ticker, 'NATION_' || substr(p_brand, 7) AS currency FROM part)
SELECT b.ticker, currency, close * volume * coalesce(rate, 1e0) AS notional, close * volume * coalesce(rate, 1e0) >= 100000 AS gate_pass
FROM (SELECT * FROM bars {LAST}) b LEFT JOIN cur USING (ticker) LEFT JOIN fx USING (currency)""")
def fx_notional_gate(spark, sf_dir):
    rates = read_table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_name").alias("currency"), (1 + F.col("n_nationkey") / 10.0).alias("rate"))
    currency = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), F.concat(F.lit("NATION_"), F.substring("p_brand", 7, 99)).alias("currency")).distinct()
    return T.notional_gate(V.bars(spark, sf_dir), currency, rates, 100000.0)


@query("""
WITH t AS (SELECT user_id AS ticker, event_id, ts, value, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM events),
s AS (SELECT *, CASE WHEN hour(l) < 4 THEN CAST(l AS DATE) - 1 ELSE CAST(l AS DATE) END AS session FROM t WHERE hour(l) >= 20 OR hour(l) < 4)
SELECT ticker, session, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
       first(value ORDER BY ts DESC, event_id DESC) AS close, count(*) AS n_ticks,
       (first(value ORDER BY ts DESC, event_id DESC) - first(value ORDER BY ts, event_id)) / nullif(first(value ORDER BY ts, event_id), 0) * 100 AS change_pct
FROM s GROUP BY ticker, session""")
def overnight_session_bars(spark, sf_dir):
    ticks = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))
    return T.overnight_bars(ticks)


@query(BARS + """, t AS (SELECT ticker, max(d) AS d FROM bars GROUP BY ticker),
h AS (SELECT *, (epoch(TIMESTAMP '2001-12-02 12:00:00') - epoch(CAST(d AS TIMESTAMP))) / 36e2 - 21 AS age_hours FROM t)
SELECT ticker, d, age_hours,
       CASE WHEN age_hours < 0 THEN 'UNKNOWN' WHEN isodow(TIMESTAMP '2001-12-02 12:00:00') >= 6 AND isodow(d) = 5 AND age_hours <= 72 THEN 'WEEKEND_EXPECTED_STALE'
            WHEN age_hours <= 28 THEN 'FRESH' WHEN age_hours <= 56 THEN 'MARKET_CLOSED_EXPECTED_STALE' WHEN age_hours <= 168 THEN 'STALE' ELSE 'VERY_STALE' END AS freshness
FROM h""")
def freshness_class(spark, sf_dir):
    return T.freshness(V.bars(spark, sf_dir), "2001-12-02 12:00:00")


@query(f"""{BARS}, {RETURNS}, {AVERAGES}, {POSITION}, {RANGE}, {VOLUME}, {SLOPE}, {VOL},
j AS (SELECT q.ticker, q.d, q.close, q.ret, pct_from_high, trend, ratio_10, volume_flag, slope_pct, direction, vol
      FROM (SELECT * FROM returns {LAST}) q LEFT JOIN ranges USING (ticker) LEFT JOIN position USING (ticker) LEFT JOIN volumes USING (ticker)
      LEFT JOIN slope USING (ticker) LEFT JOIN vols USING (ticker))
SELECT *, concat_ws(',', CASE WHEN pct_from_high IS NULL THEN 'range' END, CASE WHEN trend IS NULL THEN 'average' END, CASE WHEN ratio_10 IS NULL THEN 'volume' END,
                    CASE WHEN slope_pct IS NULL THEN 'slope' END, CASE WHEN vol IS NULL THEN 'volatility' END) AS missing
FROM j""")
def market_snapshot(spark, sf_dir):
    return T.market_snapshot(V.bars(spark, sf_dir))


@query(f"""{BARS}, {RETURNS}, {AVERAGES}, {POSITION}, {RSI}, {MACD}
SELECT q.ticker, q.d, q.close, q.ret, n_bars, rsi_14, macd, macd_signal, macd_histogram, sma_50, sma_200, trend
FROM (SELECT * FROM returns {LAST}) q JOIN rsi USING (ticker) LEFT JOIN macd USING (ticker) LEFT JOIN position USING (ticker)""")
def technical_indicators(spark, sf_dir):
    return T.technical_indicators(V.bars(spark, sf_dir))
