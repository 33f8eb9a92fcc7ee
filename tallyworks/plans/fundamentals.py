"""Queries over statements, balances and share counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fundamentals as O
from ..sources import views as V
from ..sources.tables import read_table
from .registry import Group

GROUP = Group()
query = GROUP.query

ITEMS = ["Total Revenue", "Operating Income", "EBITDA", "Interest Expense", "Reconciled Depreciation"]
COLUMNS = [i.lower().replace(" ", "_") for i in ITEMS]
ST = f"WITH {V.STATEMENTS_SQL}"
WIDE = ", ".join(f"max(value) FILTER (line_item = '{i}') AS {c}" for i, c in zip(ITEMS, COLUMNS, strict=True))
TTM = """
ttm AS (
    SELECT ticker, line_item, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS ttm, count(*) AS n_quarters, max(period) AS latest
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker, line_item ORDER BY period DESC) AS rn FROM statements) WHERE rn <= 4 GROUP BY ticker, line_item)"""


@query(f"{ST} SELECT ticker, period, {WIDE} FROM statements GROUP BY ticker, period")
def statement_pivot(spark, sf_dir):
    return O.pivot_statement(V.statements(spark, sf_dir), ITEMS)


@query(f"{ST} SELECT ticker, period, lower(replace(line_item, ' ', '_')) AS line_item, value FROM statements")
def statement_unpivot(spark, sf_dir):
    return O.unpivot_statement(O.pivot_statement(V.statements(spark, sf_dir), ITEMS), COLUMNS)


@query(f"{ST}, {TTM} SELECT * FROM ttm")
def ttm_sum(spark, sf_dir):
    return O.ttm(V.statements(spark, sf_dir))


@query(f"""{ST},
recent AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY period DESC) AS q FROM statements),
sums AS (SELECT ticker, line_item, CASE line_item WHEN 'EBITDA' THEN 1 WHEN 'Reconciled Depreciation' THEN 2 ELSE 3 END AS place,
                CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS total, count(*) AS n_quarters
         FROM recent WHERE q <= 4 AND line_item IN ('EBITDA', 'Reconciled Depreciation', 'Operating Income') GROUP BY 1, 2),
best AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY place) = 1)
SELECT t.ticker, line_item AS source_row, total, n_quarters FROM (SELECT DISTINCT ticker FROM statements) t LEFT JOIN best USING (ticker)""")
def line_item_fallback(spark, sf_dir):
    return O.line_item_fallback(V.statements(spark, sf_dir), ["EBITDA", "Reconciled Depreciation", "Operating Income"])


@query(f"""{ST}, {TTM}, {V.BALANCES_SQL},
w AS (SELECT ticker, abs(max(ttm) FILTER (line_item = 'Interest Expense')) AS interest, max(ttm) FILTER (line_item = 'Operating Income') AS ebit,
             max(ttm) FILTER (line_item = 'Reconciled Depreciation') AS depreciation, max(ttm) FILTER (line_item = 'EBITDA') AS provider_ebitda
      FROM ttm GROUP BY ticker),
e AS (SELECT *, ebit + depreciation AS operating_ebitda, coalesce(ebit + depreciation, provider_ebitda) AS ebitda,
             CASE WHEN ebit + depreciation IS NOT NULL THEN 'operating' WHEN provider_ebitda IS NOT NULL THEN 'provider_ebitda_fallback' END AS ebitda_source,
             total_debt - coalesce(cash, 0e0) AS net_debt
      FROM w LEFT JOIN balances USING (ticker)),
r AS (SELECT *, CASE WHEN ebitda > 0 THEN net_debt / ebitda END AS net_debt_to_ebitda, CASE WHEN interest > 0 THEN ebit / interest END AS coverage_ebit,
             CASE WHEN interest > 0 THEN ebitda / interest END AS coverage_ebitda,
             abs(provider_ebitda - operating_ebitda) / greatest(abs(operating_ebitda), 1e0) >= 0.25 AND abs(provider_ebitda - operating_ebitda) >= 100000000 AS ebitda_divergence
      FROM e)
SELECT *, net_debt_to_ebitda > 2.5 AND coverage_ebit < 3 AS credit_stress,
       CASE WHEN net_debt_to_ebitda IS NULL THEN NULL WHEN net_debt_to_ebitda < 1 THEN 'CLEAN' WHEN net_debt_to_ebitda <= 2.5 THEN 'MODERATE'
            WHEN net_debt_to_ebitda <= 4 THEN 'ELEVATED' ELSE 'STRESSED' END AS debt_tier
FROM r""")
def credit_health(spark, sf_dir):
    return O.credit_health(V.statements(spark, sf_dir), V.balances(spark, sf_dir))


@query(f"""{ST},
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS rn FROM statements WHERE line_item = 'Interest Expense'),
g AS (SELECT ticker, max(abs(value)) FILTER (rn = 1) AS latest,
             CAST(sum(CAST(abs(value) AS DECIMAL(28,4))) FILTER (rn > 1) AS DOUBLE) / nullif(count(*) FILTER (rn > 1), 0) AS prior_avg
      FROM r WHERE rn <= 4 GROUP BY ticker)
SELECT *, latest > 2 * prior_avg AS anomaly FROM g""")
def interest_anomaly(spark, sf_dir):
    return O.interest_anomaly(V.statements(spark, sf_dir))


@query(f"""{ST}, {V.BALANCES_SQL},
w AS (SELECT ticker, period, {WIDE} FROM statements GROUP BY ticker, period),
g AS (SELECT *, lag(total_revenue, 4) OVER (PARTITION BY ticker ORDER BY period) AS ago FROM w LEFT JOIN balances USING (ticker))
SELECT ticker, period, operating_income / nullif(total_revenue, 0) AS operating_margin, ebitda / nullif(total_revenue, 0) AS ebitda_margin,
       interest_expense / nullif(operating_income, 0) AS interest_burden, total_debt / nullif(total_revenue, 0) AS debt_to_revenue,
       (total_revenue - ago) / nullif(abs(ago), 0) * 100 AS revenue_growth_pct
FROM g""")
def financial_ratios(spark, sf_dir):
    return O.financial_ratios(V.statements(spark, sf_dir), V.balances(spark, sf_dir))


@query("""
WITH t AS (SELECT s_suppkey, CAST(abs(CAST(round(s_acctbal * 100) AS BIGINT)) // 100 AS VARCHAR) || '.' || CAST(s_suppkey % 10 AS VARCHAR)
                  || ['', 'K', 'M', 'B', 'x'][s_suppkey % 5 + 1] AS raw FROM supplier)
SELECT s_suppkey, raw, CAST(nullif(regexp_extract(raw, '^(-?[0-9]+([.][0-9]+)?)[KMBT]?$', 1), '') AS DOUBLE)
       * CASE right(raw, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1e0 END AS value
FROM t""")
def valuation_suffix_parse(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    whole = F.expr("CAST(abs(CAST(round(s_acctbal * 100) AS BIGINT)) div 100 AS STRING)")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "K", "M", "B", "x")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    raw = F.concat(whole, F.lit("."), (F.col("s_suppkey") % 10).cast("string"), suffix)
    return s.select("s_suppkey", raw.alias("raw")).withColumn("value", O.parse_suffixed(F.col("raw")))


SHARES = f"""WITH {V.SHARES_SQL},
daily AS (SELECT ticker, d, arg_max(shares, seq) AS shares FROM shares GROUP BY ticker, d),
compact AS (SELECT ticker, d, shares FROM (SELECT *, lag(shares) OVER (PARTITION BY ticker ORDER BY d) AS b FROM daily) WHERE shares IS DISTINCT FROM b OR b IS NULL)"""


@query(f"{SHARES} SELECT * FROM compact")
def share_count_compaction(spark, sf_dir):
    return O.compact_shares(V.shares(spark, sf_dir))


@query(f"""{SHARES}
SELECT *, (current_shares - first_shares) / nullif(first_shares, 0) * 100 AS change_pct
FROM (SELECT ticker, arg_min(shares, d) AS first_shares, arg_max(shares, d) AS current_shares, count(*) AS n_samples FROM compact GROUP BY ticker)""")
def share_count_trend(spark, sf_dir):
    return O.share_trend(V.shares(spark, sf_dir))
