"""Queries over fund values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import funds as O
from ..sources import views as V
from ..sources.tables import read_table
from .registry import Group

GROUP = Group()
query = GROUP.query

N = f"WITH {V.NAV_SQL}"
REQUESTS_SQL = """
requests AS (SELECT DISTINCT proj_id, CASE proj_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'main' ELSE 'error' END AS wanted FROM nav UNION SELECT 999999, 'main'),
funds AS (SELECT proj_id, CASE WHEN proj_id % 4 = 0 THEN 'all' ELSE fund_class END AS fund_class, nav_date, seq, last_val FROM nav),
classes AS (SELECT r.proj_id, wanted, count(*) FILTER (fund_class = wanted) AS exact, count(DISTINCT fund_class) AS classes, min(fund_class) AS first_class
            FROM requests r LEFT JOIN (SELECT DISTINCT proj_id, fund_class FROM funds) USING (proj_id) GROUP BY 1, 2),
resolved AS (SELECT proj_id, wanted, classes, CASE WHEN exact > 0 THEN 'OK' WHEN classes = 1 THEN 'OK_SINGLE_CLASS' WHEN classes > 1 THEN 'AMBIGUOUS' ELSE 'UNVERIFIED_NO_ROWS' END AS status,
                    CASE WHEN exact > 0 THEN wanted WHEN classes = 1 THEN first_class END AS used_class FROM classes)"""


def _funds(spark, sf_dir):
    one = F.when(F.col("proj_id") % 4 == 0, "all").otherwise(F.col("fund_class"))
    return V.nav(spark, sf_dir).withColumn("fund_class", one)


def _requests(spark, sf_dir):
    wanted = F.when(F.col("proj_id") % 3 == 0, "click").when(F.col("proj_id") % 3 == 1, "main").otherwise("error")
    some = V.nav(spark, sf_dir).select("proj_id", wanted.alias("wanted")).distinct()
    return some.unionByName(spark.range(999999, 1000000).select(F.col("id").alias("proj_id"), F.lit("main").alias("wanted")))


@query(f"""{N} SELECT proj_id, fund_class, max(nav_date) AS nav_date, first(last_val ORDER BY nav_date DESC, seq DESC) AS last_val, count(*) AS n_rows
FROM nav WHERE nav_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY proj_id, fund_class""")
def nav_latest_in_window(spark, sf_dir):
    return O.latest_nav(V.nav(spark, sf_dir), "2024-01-05", "2024-01-20")


@query(f"{N}, {REQUESTS_SQL} SELECT * FROM resolved")
def nav_class_resolution(spark, sf_dir):
    return O.resolve_class(_requests(spark, sf_dir), _funds(spark, sf_dir))


@query(f"""{N}, {REQUESTS_SQL}, last AS (SELECT proj_id, fund_class AS used_class, max(nav_date) AS nav_date, first(last_val ORDER BY nav_date DESC, seq DESC) AS last_val FROM funds GROUP BY 1, 2)
SELECT proj_id, wanted, status, nav_date, last_val FROM resolved LEFT JOIN last USING (proj_id, used_class)""")
def nav_batch_status(spark, sf_dir):
    return O.batch_nav(_requests(spark, sf_dir), _funds(spark, sf_dir))


@query(f"""{N}, d AS (SELECT proj_id, nav_date AS pay_date, seq, last_val AS amount FROM nav WHERE fund_class = 'purchase'),
r AS (SELECT *, row_number() OVER w AS rn, lead(amount) OVER w AS b FROM d WINDOW w AS (PARTITION BY proj_id ORDER BY pay_date DESC, seq DESC))
SELECT proj_id, pay_date, amount, CAST(rn AS INTEGER) AS rn, (amount - b) / nullif(abs(b), 0) AS change FROM r WHERE rn <= 5""")
def dividend_history(spark, sf_dir):
    d = V.nav(spark, sf_dir).where("fund_class = 'purchase'").select("proj_id", F.col("nav_date").alias("pay_date"), "seq", F.col("last_val").alias("amount"))
    return O.dividends_since(d, 5)


@query(f"{N} SELECT nav_date, seq, proj_id, last_val FROM nav WHERE (nav_date > DATE '2024-01-10' OR (nav_date = DATE '2024-01-10' AND seq > 3200)) ORDER BY nav_date, seq LIMIT 40")
def dividend_page_sorted(spark, sf_dir):
    rows = V.nav(spark, sf_dir).select("nav_date", "seq", "proj_id", "last_val")
    import datetime

    return O.keyset_page(rows, (datetime.date(2024, 1, 10), 3200), ["nav_date", "seq"], 40)


@query("""WITH p AS (SELECT c_custkey AS proj_id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier)
SELECT proj_id, name, CASE WHEN lower(name) = 'supplier#000000012' THEN 'exact' WHEN starts_with(lower(name), 'supplier#000000012') THEN 'prefix' ELSE 'contains' END AS match
FROM p WHERE contains(lower(name), 'supplier#000000012') UNION ALL
SELECT proj_id, name, CASE WHEN lower(name) = '0012' THEN 'exact' WHEN starts_with(lower(name), '0012') THEN 'prefix' ELSE 'contains' END FROM p WHERE contains(lower(name), '0012')""")
def profile_search_union(spark, sf_dir):
    c, s = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    p = c.select(F.col("c_custkey").alias("proj_id"), F.col("c_name").alias("name")).unionByName(s.select(F.col("s_suppkey").alias("proj_id"), F.col("s_name").alias("name")))
    return O.search_profiles(p, "Supplier#000000012").unionByName(O.search_profiles(p, "0012"))


@query("""WITH p AS (SELECT p_partkey AS proj_id, p_name || ' ' || CAST(p_size AS VARCHAR) AS name FROM part), r AS (SELECT DISTINCT name FROM p UNION SELECT 'no such fund'),
f AS (SELECT name, count(proj_id) AS n, min(proj_id) AS proj_id FROM r LEFT JOIN p USING (name) GROUP BY name)
SELECT name, n, CASE WHEN n = 1 THEN 'OK' WHEN n = 0 THEN 'NOT_FOUND' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN proj_id END AS proj_id FROM f""")
def profile_resolution(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("proj_id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"))
    requests = p.select("name").distinct().unionByName(spark.range(1).select(F.lit("no such fund").alias("name")))
    return O.resolve_profile(requests, p)
