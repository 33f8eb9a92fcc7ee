"""Queries over grades, estimates and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyst as O
from ..operators import timeseries as T
from ..sources import views as V
from ..sources.tables import read_table
from . import technicals as S
from .registry import Group

GROUP = Group()
query = GROUP.query

R = f"WITH {V.RATINGS_SQL}"
E = f"WITH {V.EPS_SQL}"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


CHANGES = f"""
plain AS (SELECT *, lower(trim(coalesce(action, ''))) AS a, lower(trim(coalesce(from_grade, ''))) AS o, lower(trim(coalesce(to_grade, ''))) AS n FROM ratings),
changes AS (
    SELECT * EXCLUDE (a, o, n), CASE WHEN a IN {_in(O.INITIATION_ACTIONS)} OR starts_with(a, 'init') THEN 'INITIATED' WHEN contains(a, 'downgrade') OR a = 'down' THEN 'DOWNGRADE'
           WHEN contains(a, 'upgrade') OR a = 'up' THEN 'UPGRADE' WHEN n IN {_in(O.DOWNGRADE_GRADES)} AND o NOT IN {_in(O.DOWNGRADE_GRADES)} THEN 'DOWNGRADE'
           WHEN n IN {_in(O.UPGRADE_GRADES)} AND o <> '' AND o NOT IN {_in(O.UPGRADE_GRADES)} THEN 'UPGRADE' WHEN n <> '' AND o = '' THEN 'INITIATED' ELSE 'MAINTAIN' END AS change
    FROM plain)"""
FIRMS = "firms AS (SELECT * FROM ratings QUALIFY row_number() OVER (PARTITION BY ticker, firm ORDER BY grade_date DESC, seq DESC) = 1)"
CONSENSUS = """
grades AS (SELECT ticker, to_grade, count(*) AS n FROM firms GROUP BY ticker, to_grade),
consensus AS (SELECT ticker, to_grade AS consensus, n, n / sum(n) OVER (PARTITION BY ticker) AS share FROM grades
              QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, to_grade) = 1)"""
SURPRISES = """
surprises AS (SELECT ticker, period, actual, estimate, actual - estimate AS delta,
                     CASE WHEN abs(estimate) >= 0.01 THEN (actual - estimate) / nullif(abs(estimate), 0) * 100 END AS surprise_pct, actual - estimate > 0 AS beat
              FROM eps WHERE estimate IS NOT NULL)"""


@query(f"{R}, {CHANGES} SELECT * FROM changes")
def rating_change_class(spark, sf_dir):
    return O.classify_change(V.ratings(spark, sf_dir))


@query(f"{R}, {FIRMS} SELECT * FROM firms")
def latest_grade_per_firm(spark, sf_dir):
    return O.latest_per_firm(V.ratings(spark, sf_dir))


@query(f"""{R}, {CHANGES}
SELECT *, upgrades - downgrades AS net FROM (
    SELECT ticker, count(*) FILTER (change = 'INITIATED') AS initiated, count(*) FILTER (change = 'UPGRADE') AS upgrades,
           count(*) FILTER (change = 'DOWNGRADE') AS downgrades, count(*) FILTER (change = 'MAINTAIN') AS maintained
    FROM changes WHERE grade_date BETWEEN DATE '1999-06-30' - 90 AND DATE '1999-06-30' GROUP BY ticker)""")
def rating_change_radar(spark, sf_dir):
    return O.change_radar(V.ratings(spark, sf_dir), "1999-06-30")


@query(f"{R}, {FIRMS}, {CONSENSUS} SELECT * FROM consensus")
def consensus_dominant(spark, sf_dir):
    return O.consensus(V.ratings(spark, sf_dir))


@query(f"{E}, {SURPRISES} SELECT * FROM surprises")
def eps_surprise(spark, sf_dir):
    return O.surprises(V.eps(spark, sf_dir))


@query(f"""{E}, {SURPRISES},
m AS (SELECT *, sum(CASE WHEN beat THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY period DESC) AS misses FROM surprises),
g AS (SELECT ticker, count(*) FILTER (misses = 0) AS streak, count(*) FILTER (beat) AS beats, count(*) AS n FROM m GROUP BY ticker)
SELECT *, beats / n AS beat_rate, CASE WHEN beats / n >= 0.75 THEN 'STRONG' WHEN beats / n >= 0.55 THEN 'POSITIVE' WHEN beats / n >= 0.40 THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS surprise_signal FROM g""")
def beat_streak(spark, sf_dir):
    return O.beat_streak(V.eps(spark, sf_dir))


@query(f"""{E},
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS rn FROM eps),
w AS (SELECT ticker, max(estimate) FILTER (rn = 1) AS e1, max(estimate) FILTER (rn = 2) AS e2, max(actual) FILTER (rn = 1) AS a1, max(actual) FILTER (rn = 5) AS a5 FROM r GROUP BY ticker),
p AS (SELECT ticker, (e1 - e2) / nullif(abs(e2), 0) * 100 AS revision_pct, (a1 - a5) / nullif(abs(a5), 0) * 100 AS growth_pct FROM w),
c AS (SELECT *, CASE WHEN revision_pct IS NULL THEN NULL WHEN revision_pct >= 3 THEN 'UPGRADING' WHEN revision_pct <= -3 THEN 'DOWNGRADING' ELSE 'STABLE' END AS revision,
             CASE WHEN growth_pct IS NULL THEN 'NO_HISTORY' WHEN growth_pct > 10 THEN 'STRONG' WHEN growth_pct >= 0 THEN 'POSITIVE' WHEN growth_pct > -10 THEN 'NEGATIVE' ELSE 'COLLAPSING' END AS momentum FROM p)
SELECT *, CASE WHEN revision = 'UPGRADING' AND momentum IN ('STRONG', 'POSITIVE') THEN 'POSITIVE_CONFIRMED' WHEN revision = 'DOWNGRADING' AND momentum NOT IN ('STRONG', 'POSITIVE') THEN 'NEGATIVE_CONFIRMED'
               WHEN revision = 'UPGRADING' THEN 'MIXED_POSITIVE_REVISION' WHEN revision = 'DOWNGRADING' THEN 'MIXED_NEGATIVE_REVISION'
               WHEN momentum IN ('STRONG', 'POSITIVE') THEN 'STABLE_POSITIVE' ELSE 'STABLE_NEGATIVE' END AS composite FROM c""")
def earnings_momentum(spark, sf_dir):
    return O.momentum(V.eps(spark, sf_dir))


@query(f"""{E},
a AS (SELECT ticker, period, actual, year(period) || '-Q' || quarter(period) AS label FROM eps),
e AS (SELECT ticker, CASE WHEN ticker % 3 = 0 THEN year(period) || '-Q' || quarter(period) ELSE 'unlabelled ' || period END AS label,
             CASE WHEN ticker % 3 = 2 THEN NULL ELSE period END AS period_end, estimate FROM eps WHERE estimate IS NOT NULL)
SELECT a.ticker, a.period, a.label, actual, coalesce(l.estimate, d.estimate) AS estimate,
       CASE WHEN l.estimate IS NOT NULL THEN 'MATCHED' WHEN d.estimate IS NOT NULL THEN 'UNVERIFIED' ELSE 'INCOMPLETE' END AS alignment
FROM a LEFT JOIN e l ON a.ticker = l.ticker AND a.label = l.label LEFT JOIN e d ON a.ticker = d.ticker AND a.period = d.period_end""")
def eps_surprise_join(spark, sf_dir):
    eps = V.eps(spark, sf_dir)
    label = F.concat(F.year("period").cast("string"), F.lit("-Q"), F.quarter("period").cast("string"))
    actuals = eps.select("ticker", "period", "actual", label.alias("label"))
    own = F.when(F.col("ticker") % 3 == 0, label).otherwise(F.concat(F.lit("unlabelled "), F.col("period").cast("string")))
    estimates = eps.where("estimate is not null").select("ticker", own.alias("label"), F.when(F.col("ticker") % 3 != 2, F.col("period")).alias("period_end"), "estimate")
    return O.estimate_match(actuals, estimates)


@query("""SELECT o_orderkey, d, CAST(row_number() OVER (ORDER BY d, o_orderkey) AS INTEGER) AS position, true AS has_more
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY d, o_orderkey LIMIT 25 OFFSET 50)""")
def calendar_page(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return O.calendar_page(o, ["d", "o_orderkey"], 25, 50)


TARGETS = "targets AS (SELECT p_brand AS ticker, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 1e2 * 2 AS target FROM part WHERE p_size > 25 GROUP BY p_brand)"


def _targets(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").where("p_size > 25")
    return p.groupBy(F.col("p_brand").alias("ticker")).agg((F.sum(F.expr("CAST(round(p_retailprice * 100) AS BIGINT)")).cast("double") / F.count("*") / 100.0 * 2).alias("target"))


@query(f"""{S.BARS}, {TARGETS},
p AS (SELECT ticker, close, target, close / nullif(target, 0) * 100 AS pct_of_target FROM (SELECT ticker, close FROM bars {S.LAST}) LEFT JOIN targets USING (ticker))
SELECT *, CASE WHEN pct_of_target IS NULL THEN NULL WHEN pct_of_target <= 75 THEN 'STRONG_BUY' WHEN pct_of_target <= 90 THEN 'ACCEPTABLE' WHEN pct_of_target <= 100 THEN 'CAUTION' ELSE 'AVOID' END AS bracket,
       CASE WHEN pct_of_target IS NULL THEN NULL WHEN pct_of_target < 40 THEN 'SPECULATIVE' WHEN pct_of_target < 80 THEN 'LONG' WHEN pct_of_target < 100 THEN 'NEAR' ELSE 'INVERTED' END AS tag
FROM p""")
def price_target_bracket(spark, sf_dir):
    quotes = T.latest(V.bars(spark, sf_dir).select("ticker", "d", "close")).drop("d")
    return O.target_position(quotes, _targets(spark, sf_dir))


@query(f"""{S.BARS}, {S.RETURNS}, {S.VOL}, {S.SLOPE}, {S.RSI}, {TARGETS}
SELECT ticker, rsi_14, vol, slope_pct, target, concat_ws(',', CASE WHEN rsi.n_bars IS NULL THEN 'rsi' END, CASE WHEN n_returns IS NULL THEN 'volatility' END,
       CASE WHEN direction IS NULL THEN 'slope' END, CASE WHEN target IS NULL THEN 'target' END) AS missing
FROM rsi FULL JOIN vols USING (ticker) FULL JOIN slope USING (ticker) FULL JOIN targets USING (ticker)""")
def position_inputs(spark, sf_dir):
    bars = V.bars(spark, sf_dir)
    return O.position_inputs({"rsi": T.rsi(bars).select("ticker", "rsi_14"), "volatility": T.realized_volatility(bars).select("ticker", "vol"), "slope": T.price_slope(bars).select("ticker", "slope_pct"), "target": _targets(spark, sf_dir)})
