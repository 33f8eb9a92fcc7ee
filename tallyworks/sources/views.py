"""Market tables (bars, option contracts, statements, ratings, ...) as views of the star schema.

Prices are whole micro-dollars until the last step, so that sums do not depend
on their order. The SQL of each view stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .tables import read_table

PRICE = "CAST(round(l_extendedprice * 100) AS BIGINT) * 10000 {div} CAST(l_quantity AS BIGINT)"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: ticker, date, price and its order within the day."""
    lines = read_table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    joined = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    price = F.expr(PRICE.format(div="div"))
    return joined.select(
        F.col("p_brand").alias("ticker"),
        F.to_date("l_shipdate").alias("d"),
        price.alias("px"),
        F.expr("px * CAST(round((1 - l_discount) * 100) AS BIGINT) div 100").alias("adj"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px").alias("seq"),
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_linenumber",
        "p_retailprice",
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: ticker, d, open, high, low, close, adj_close and volume."""
    day = trades(spark, sf_dir).groupBy("ticker", "d").agg(
        F.min_by("px", "seq").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "seq").alias("close"),
        F.max_by("adj", "seq").alias("adj_close"),
        F.sum("quantity").alias("volume"),
    )
    prices = [(F.col(c) / 1e6).alias(c) for c in ("open", "high", "low", "close", "adj_close")]
    return day.select("ticker", "d", *prices, "volume")


_SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, px"
_DESC = "l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, px DESC"
TRADES_SQL = f"""
trades AS (
    SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS d, {PRICE.format(div="//")} AS px,
           ({PRICE.format(div="//")}) * CAST(round((1 - l_discount) * 100) AS BIGINT) // 100 AS adj,
           CAST(l_quantity AS BIGINT) AS quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_discount, l_tax, l_returnflag, l_linestatus, p_retailprice
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0)"""
BARS_SQL = f"""{TRADES_SQL},
bars AS (
    SELECT ticker, d, first(px ORDER BY {_SEQ}) / 1e6 AS open, max(px) / 1e6 AS high, min(px) / 1e6 AS low,
           first(px ORDER BY {_DESC}) / 1e6 AS close, first(adj ORDER BY {_DESC}) / 1e6 AS adj_close,
           CAST(sum(quantity) AS BIGINT) AS volume
    FROM trades GROUP BY ticker, d)"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option contracts: one row per ticker, expiration, type and strike. Bid, ask and IV are in hundredths of a cent."""
    t = trades(spark, sf_dir)
    cents = {c: F.expr(f"CAST(round({c} * 100) AS BIGINT)") for c in ("l_discount", "l_tax")}
    rows = t.select(
        "ticker",
        F.last_day("d").alias("expiration"),
        F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("kind"),
        (F.floor(F.col("p_retailprice") / 5) * 5).alias("strike"),
        cents["l_discount"].alias("disc"),
        cents["l_tax"].alias("tax"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.when(F.col("l_returnflag") == "N", F.col("quantity")).otherwise(0).alias("open_q"),
        "d",
    )
    grouped = rows.groupBy("ticker", "expiration", "kind", "strike").agg(
        F.min("disc").alias("disc"), F.min("tax").alias("tax"), F.sum("line").alias("volume"), F.sum("open_q").alias("open_interest"), F.sum("disc").alias("discs"), F.count("*").alias("n"), F.max("d").alias("last_trade")
    )
    return grouped.select(
        "ticker",
        "expiration",
        "kind",
        "strike",
        (F.greatest(F.lit(0), F.col("disc") * 10 - 20) / 100.0).alias("bid"),
        ((F.greatest(F.lit(0), F.col("disc") * 10 - 20) + F.col("tax") * 10) / 100.0).alias("ask"),
        "volume",
        "open_interest",
        (F.col("discs") / F.col("n") / 100.0).alias("iv"),
        "last_trade",
    )


CONTRACTS_SQL = f"""{TRADES_SQL},
raw_contracts AS (
    SELECT ticker, last_day(d) AS expiration, CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS kind,
           CAST(floor(p_retailprice / 5) AS BIGINT) * 5 AS strike, CAST(round(l_discount * 100) AS BIGINT) AS disc,
           CAST(round(l_tax * 100) AS BIGINT) AS tax, l_linenumber AS line,
           CASE WHEN l_returnflag = 'N' THEN quantity ELSE 0 END AS open_q, d
    FROM trades),
contracts AS (
    SELECT ticker, expiration, kind, strike, greatest(0, min(disc) * 10 - 20) / 1e2 AS bid,
           (greatest(0, min(disc) * 10 - 20) + min(tax) * 10) / 1e2 AS ask,
           CAST(sum(line) AS BIGINT) AS volume, CAST(sum(open_q) AS BIGINT) AS open_interest,
           CAST(sum(disc) AS DOUBLE) / count(*) / 1e2 AS iv, max(d) AS last_trade
    FROM raw_contracts GROUP BY ticker, expiration, kind, strike)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements in long form: ticker, period (quarter start), line_item, value in whole cents as a double."""
    lines = read_table(spark, sf_dir, "lineitem")
    cents = F.expr("CAST(round(l_extendedprice * 100) AS BIGINT)")
    q = lines.select(
        F.col("l_suppkey").alias("ticker"),
        F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period"),
        (cents * F.expr("CAST(round((1 - l_discount) * 100) AS BIGINT)")).alias("rev"),
        F.when(F.col("l_returnflag") == "R", cents * F.expr("CAST(round(l_tax * 100) AS BIGINT)")).alias("interest"),
        F.col("l_quantity").cast("long").alias("qty"),
    )
    sums = q.groupBy("ticker", "period").agg(F.sum("rev").alias("rev"), F.sum("interest").alias("interest"), F.sum("qty").alias("qty"))
    op = F.expr("rev div 5")
    da = F.col("qty") * 10000
    items = {
        "Total Revenue": F.col("rev"),
        "Interest Expense": F.col("interest"),
        "Operating Income": op,
        "Reconciled Depreciation": F.when(F.col("ticker") % 7 != 0, da),
        "EBITDA": F.when(F.col("ticker") % 5 != 0, op + da),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("line_item"), (v.cast("double") / 10000).alias("value")) for k, v in items.items()]))
    return sums.select("ticker", "period", rows.alias("r")).select("ticker", "period", "r.line_item", "r.value").where("value is not null")


STATEMENTS_SQL = """
quarter_sums AS (
    SELECT l_suppkey AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS rev,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) END) AS BIGINT) AS interest,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
    FROM lineitem GROUP BY 1, 2),
statements AS (
    SELECT ticker, period, line_item, CAST(v AS DOUBLE) / 1e4 AS value FROM (
        SELECT ticker, period, 'Total Revenue' AS line_item, rev AS v FROM quarter_sums
        UNION ALL SELECT ticker, period, 'Interest Expense', interest FROM quarter_sums
        UNION ALL SELECT ticker, period, 'Operating Income', rev // 5 FROM quarter_sums
        UNION ALL SELECT ticker, period, 'Reconciled Depreciation', qty * 10000 FROM quarter_sums WHERE ticker % 7 <> 0
        UNION ALL SELECT ticker, period, 'EBITDA', rev // 5 + qty * 10000 FROM quarter_sums WHERE ticker % 5 <> 0)
    WHERE v IS NOT NULL)"""


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """total_debt and cash of each supplier ticker."""
    s = read_table(spark, sf_dir, "supplier")
    cents = F.expr("CAST(round(s_acctbal * 100) AS BIGINT)")
    return s.select(F.col("s_suppkey").alias("ticker"), (F.abs(cents) * 200 / 100.0).alias("total_debt"), (F.greatest(cents, F.lit(0)) / 100.0).alias("cash"))


BALANCES_SQL = """
balances AS (
    SELECT s_suppkey AS ticker, abs(CAST(round(s_acctbal * 100) AS BIGINT)) * 200 / 1e2 AS total_debt,
           greatest(CAST(round(s_acctbal * 100) AS BIGINT), 0) / 1e2 AS cash
    FROM supplier)"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share counts over time, with repeated timestamps: ticker, d, seq, shares."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("seq"), F.floor(F.col("o_totalprice") / 100000).alias("shares"))


SHARES_SQL = """
shares AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS d, o_orderkey AS seq, CAST(floor(o_totalprice / 100000) AS BIGINT) AS shares FROM orders)"""

GRADES = {"1-URGENT": "Strong Buy", "2-HIGH": "Outperform", "3-MEDIUM": "Hold", "4-NOT SPECIFIED": "Underperform", "5-LOW": "Sell"}


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst grades: ticker, grade_date, firm, seq, from_grade, to_grade and action."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    grade = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in GRADES.items()])
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("grade_date"), F.col("o_custkey").alias("firm"), F.col("o_orderkey").alias("seq"), grade.alias("to_grade"), F.col("o_orderstatus").alias("status")
    )
    before = F.lag("to_grade").over(W.Window.partitionBy("ticker", "firm").orderBy("grade_date", "seq"))
    action = F.when(F.col("status") == "P", "").when(F.col("from_grade").isNull(), "init").when(F.col("status") == "F", "main").otherwise("reit")
    return rows.withColumn("from_grade", before).withColumn("action", action).drop("status")


RATINGS_SQL = f"""
graded AS (
    SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS grade_date, o_custkey AS firm, o_orderkey AS seq,
           CASE {" ".join(f"WHEN o_orderpriority = '{k}' THEN '{v}'" for k, v in GRADES.items())} END AS to_grade, o_orderstatus AS status
    FROM orders JOIN customer ON o_custkey = c_custkey),
ratings AS (
    SELECT ticker, grade_date, firm, seq, to_grade, from_grade,
           CASE WHEN status = 'P' THEN '' WHEN from_grade IS NULL THEN 'init' WHEN status = 'F' THEN 'main' ELSE 'reit' END AS action
    FROM (SELECT *, lag(to_grade) OVER (PARTITION BY ticker, firm ORDER BY grade_date, seq) AS from_grade FROM graded))"""


def eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly actuals and estimates: ticker, period, actual, estimate (the quarter before's actual)."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    cents = F.sum(F.expr("CAST(round(o_totalprice * 100) AS BIGINT)"))
    quarter = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("ticker"), quarter.alias("period")).agg((cents.cast("double") / F.count("*") / 1e8).alias("actual"))
    return rows.withColumn("estimate", F.lag("actual").over(W.Window.partitionBy("ticker").orderBy("period")))


EPS_SQL = """
eps AS (
    SELECT *, lag(actual) OVER (PARTITION BY ticker ORDER BY period) AS estimate FROM (
        SELECT c_nationkey AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period,
               CAST(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / count(*) / 1e8 AS actual
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"""

SOURCES = ("official_filing", "press_release", "news_wire", "aggregator")
TERMS = ("earnings beat", "raises guidance", "signs contract", "debt offering", "product launch", "price target", "inflation", "lawsuit", "director buys", "8-k filing")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items: item_id, ticker, source, source_rank, title, published_at. Titles are the documents' first lines with a topic."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.substring_index(F.col("text"), "\n", 1).alias("line"))
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    n = len(TERMS)
    topic = F.element_at(F.array(*[F.lit(t) for t in TERMS]), (F.col("doc_id") % n + 1).cast("int"))
    rank = (F.col("doc_id") % 4).cast("int")
    return d.join(e, d["doc_id"] == e["event_id"]).select(
        F.col("doc_id").alias("item_id"),
        F.concat(F.lit("T"), (F.col("user_id") % 25).cast("string")).alias("ticker"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCES]), rank + 1).alias("source"),
        rank.alias("source_rank"),
        F.when(F.col("doc_id") % 3 == 0, F.concat("line", F.lit(" "), topic)).otherwise(F.col("line")).alias("title"),
        F.col("ts").alias("published_at"),
    )


_TERM_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_SOURCE_LIST = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"
NEWS_SQL = f"""
news AS (
    SELECT doc_id AS item_id, 'T' || CAST(user_id % 25 AS VARCHAR) AS ticker, {_SOURCE_LIST}[doc_id % 4 + 1] AS source,
           CAST(doc_id % 4 AS INTEGER) AS source_rank,
           CASE WHEN doc_id % 3 = 0 THEN line || ' ' || {_TERM_LIST}[doc_id % {len(TERMS)} + 1] ELSE line END AS title,
           ts AS published_at
    FROM (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents) JOIN events ON doc_id = event_id)"""


def geo_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual revenue facts by segment: accn, region, nation, segment, start, end, filed, form, value."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    dims = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(dims, c["c_nationkey"] == dims["n_nationkey"])
    year = F.year("o_orderdate")
    cents = F.sum(F.expr("CAST(round(o_totalprice * 100) AS BIGINT)"))
    out = rows.groupBy(F.col("c_mktsegment").alias("ticker"), year.alias("fy"), F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(cents.alias("cents"))
    return out.withColumn("start", F.make_date("fy", F.lit(1), F.lit(1))).withColumn("end", F.make_date("fy", F.lit(12), F.lit(31))).withColumn("filed", F.date_add("end", 45))


GEO_SQL = """
geo AS (
    SELECT *, make_date(CAST(fy AS BIGINT), 1, 1) AS start, make_date(CAST(fy AS BIGINT), 12, 31) AS "end", make_date(CAST(fy AS BIGINT), 12, 31) + 45 AS filed FROM (
        SELECT c_mktsegment AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fy, r_name AS region, n_name AS nation,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2, 3, 4))"""


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fund values: proj_id, fund_class, nav_date, seq and last_val."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("proj_id"), F.col("event_type").alias("fund_class"), F.to_date("ts").alias("nav_date"), F.col("event_id").alias("seq"), F.col("value").alias("last_val"))


NAV_SQL = """
nav AS (SELECT user_id AS proj_id, event_type AS fund_class, CAST(ts AS DATE) AS nav_date, event_id AS seq, value AS last_val FROM events)"""
