"""Queries over option contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import options as O
from ..sources import views as V
from ..sources.tables import read_table
from .registry import Group

GROUP = Group()
query = GROUP.query

AS_OF = "2001-12-31"
C = f"WITH {V.CONTRACTS_SQL}, spots AS (SELECT p_brand AS ticker, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 1e2 AS spot FROM part GROUP BY p_brand)"
ITM = "CASE WHEN kind = 'call' THEN strike < spot ELSE strike > spot END"
QUALITY = f"""
counts AS (
    SELECT ticker, expiration, count(*) AS n, count(*) FILTER (bid <= 0 AND ask <= 0) AS n_zero_quote, count(*) FILTER (open_interest <= 0) AS n_zero_oi,
           count(*) FILTER (iv <= 0.0001) AS n_placeholder_iv, count(*) FILTER (DATE '{AS_OF}' - last_trade > 7) AS n_stale
    FROM contracts GROUP BY ticker, expiration),
quality AS (
    SELECT *, CASE WHEN n_zero_quote / n > 0.5 OR n_zero_oi / n > 0.8 OR n_placeholder_iv / n > 0.5 OR n_stale / n > 0.5 THEN 'LOW'
                   WHEN n_zero_quote / n > 0.3 OR n_zero_oi / n > 0.5 OR n_placeholder_iv / n > 0.3 OR n_stale / n > 0.3 THEN 'MEDIUM' ELSE 'HIGH' END AS quality,
           concat_ws(',', CASE WHEN n_zero_quote / n > 0.5 THEN 'zero_quote' END, CASE WHEN n_zero_oi / n > 0.5 THEN 'zero_oi' END,
                     CASE WHEN n_placeholder_iv / n > 0.5 THEN 'placeholder_iv' END, CASE WHEN n_stale / n > 0.5 THEN 'stale' END) AS warnings
    FROM counts)"""
PUT_CALL = """
flows AS (
    SELECT *, put_volume / nullif(call_volume, 0) AS pc_volume, put_open_interest / nullif(call_open_interest, 0) AS pc_open_interest
    FROM (SELECT ticker, expiration, CAST(sum(CASE WHEN kind = 'put' THEN volume ELSE 0 END) AS BIGINT) AS put_volume, CAST(sum(CASE WHEN kind = 'call' THEN volume ELSE 0 END) AS BIGINT) AS call_volume,
                 CAST(sum(CASE WHEN kind = 'put' THEN open_interest ELSE 0 END) AS BIGINT) AS put_open_interest, CAST(sum(CASE WHEN kind = 'call' THEN open_interest ELSE 0 END) AS BIGINT) AS call_open_interest
          FROM contracts GROUP BY ticker, expiration))"""


def spots(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("ticker")).agg((F.sum(F.expr("CAST(round(p_retailprice * 100) AS BIGINT)")).cast("double") / F.count("*") / 100.0).alias("spot"))


@query(f"{C} SELECT contracts.*, spot, {ITM} AS in_the_money FROM contracts JOIN spots USING (ticker) WHERE strike BETWEEN spot * (1e0 - 0.02e0) AND spot * (1e0 + 0.02e0)")
def chain_near_money(spark, sf_dir):
    return O.near_money(V.contracts(spark, sf_dir), spots(spark, sf_dir), 0.02)


@query(f"{C} SELECT ticker, kind, {ITM} AS in_the_money, count(*) AS n FROM contracts JOIN spots USING (ticker) GROUP BY 1, 2, 3")
def chain_itm_otm(spark, sf_dir):
    joined = V.contracts(spark, sf_dir).join(spots(spark, sf_dir), "ticker")
    return joined.groupBy("ticker", "kind", O.in_the_money().alias("in_the_money")).agg(F.count("*").alias("n"))


@query(f"{C} SELECT * FROM contracts WHERE (bid > 0 OR ask > 0 OR open_interest > 0) AND volume >= 5")
def chain_liquidity_filter(spark, sf_dir):
    return O.liquid(V.contracts(spark, sf_dir), least_volume=5)


@query(f"{C}, {QUALITY} SELECT * FROM quality")
def chain_quality(spark, sf_dir):
    return O.chain_quality(V.contracts(spark, sf_dir), AS_OF)


@query(f"""{C} SELECT ticker, expiration, kind, strike, CAST(relevance AS INTEGER) AS relevance FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, expiration ORDER BY (bid > 0 AND ask > 0) DESC, (open_interest > 0 OR volume > 0) DESC, (iv > 0.0001) DESC,
           abs(strike - spot) ASC NULLS LAST, open_interest DESC, volume DESC, CASE WHEN bid > 0 AND ask > 0 THEN ask - bid ELSE 9999 END, kind, strike) AS relevance
    FROM contracts LEFT JOIN spots USING (ticker)) WHERE relevance <= 5""")
def chain_relevance_topk(spark, sf_dir):
    return O.most_relevant(V.contracts(spark, sf_dir), spots(spark, sf_dir), 5)


@query(f"{C}, {PUT_CALL} SELECT * FROM flows")
def put_call_ratio(spark, sf_dir):
    return O.put_call(V.contracts(spark, sf_dir))


@query(f"""{C} SELECT ticker, expiration, first(iv ORDER BY abs(strike - spot), strike) FILTER (kind = 'call') AS call_iv,
       first(iv ORDER BY abs(strike - spot), strike) FILTER (kind = 'put') AS put_iv, first(spot) AS spot FROM contracts JOIN spots USING (ticker) GROUP BY ticker, expiration""")
def atm_iv(spark, sf_dir):
    return O.atm_iv(V.contracts(spark, sf_dir), spots(spark, sf_dir))


@query(f"""{C},
k AS (SELECT DISTINCT ticker, expiration, strike FROM contracts),
p AS (SELECT k.ticker, k.expiration, k.strike, CAST(sum(open_interest * CASE WHEN kind = 'call' THEN greatest(k.strike - c.strike, 0) ELSE greatest(c.strike - k.strike, 0) END) AS BIGINT) AS payout
      FROM k JOIN contracts c ON k.ticker = c.ticker AND k.expiration = c.expiration GROUP BY ALL)
SELECT ticker, expiration, first(strike ORDER BY payout, strike) AS max_pain, min(payout) AS payout, count(*) AS n_strikes FROM p GROUP BY ticker, expiration""")
def max_pain_min_loss(spark, sf_dir):
    return O.max_pain(V.contracts(spark, sf_dir))


@query(f"""{C}, s AS (SELECT ticker, expiration, strike, CAST(sum(open_interest) AS BIGINT) AS open_interest FROM contracts GROUP BY ALL)
SELECT ticker, expiration, first(strike ORDER BY open_interest DESC, strike) AS max_oi_strike, max(open_interest) AS open_interest FROM s GROUP BY ticker, expiration""")
def max_pain_max_oi(spark, sf_dir):
    return O.most_open_interest(V.contracts(spark, sf_dir))


@query(f"""{C},
r AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY expiration) AS n, (spot - strike) / spot AS otm_pct,
             CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 END AS mid FROM contracts JOIN spots USING (ticker) WHERE kind = 'put')
SELECT ticker, expiration, strike, mid, otm_pct, mid / spot AS cost_pct FROM r WHERE n <= 2 AND otm_pct BETWEEN 0.001e0 AND 0.15e0 AND mid IS NOT NULL""")
def put_hedge_candidates(spark, sf_dir):
    return O.put_hedges(V.contracts(spark, sf_dir), spots(spark, sf_dir), low=0.001)


@query(f"""{C} SELECT ticker, expiration, kind, strike, iv, CASE WHEN iv > 0 THEN
       count(*) FILTER (iv > 0) OVER (PARTITION BY ticker ORDER BY iv RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY ticker) END AS iv_percentile
FROM contracts""")
def iv_percentile(spark, sf_dir):
    return O.iv_percentile(V.contracts(spark, sf_dir))


@query(f"""{C}, w AS (SELECT DISTINCT p_brand AS ticker, DATE '1997-06-15' AS wanted FROM part), dates AS (SELECT DISTINCT ticker, expiration FROM contracts)
SELECT ticker, wanted, first(expiration ORDER BY abs(expiration - wanted), expiration) AS expiration, CAST(min(abs(expiration - wanted)) AS INTEGER) AS days_off
FROM w JOIN dates USING (ticker) GROUP BY ticker, wanted""")
def nearest_expiry(spark, sf_dir):
    wanted = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), F.lit("1997-06-15").cast("date").alias("wanted")).distinct()
    return O.nearest_expiry(V.contracts(spark, sf_dir), wanted)


@query(f"""{C}, {QUALITY}, {PUT_CALL},
t AS (SELECT *, put_volume / nullif(lag(put_volume) OVER (PARTITION BY ticker ORDER BY expiration), 0) AS r FROM flows JOIN quality USING (ticker, expiration)),
u AS (SELECT *, CASE WHEN r IS NULL THEN NULL WHEN r > 1.1 THEN 'INCREASING' WHEN r < 0.9 THEN 'DECREASING' ELSE 'STABLE' END AS put_trend FROM t)
SELECT ticker, expiration, pc_volume, put_trend, quality,
       CASE WHEN quality = 'LOW' OR pc_volume IS NULL THEN NULL WHEN pc_volume >= 1.3 OR (pc_volume >= 1.0 AND coalesce(put_trend = 'INCREASING', false)) THEN 'UPPER'
            WHEN pc_volume <= 0.8 AND NOT coalesce(put_trend = 'INCREASING', false) THEN 'LOWER' ELSE 'MID' END AS bracket
FROM u""")
def options_flow_bracket(spark, sf_dir):
    return O.flow_bracket(V.contracts(spark, sf_dir), AS_OF)
