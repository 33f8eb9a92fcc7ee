"""Queries over evidence: ladders of coverage and lag, source policies, registries, filings and facts chosen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..operators import evidence as O
from ..sources import views as V
from ..sources.tables import read_table
from .facts import FILINGS_SQL, filings
from .registry import Group

GROUP = Group()
query = GROUP.query


def pick(key: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))


def in_sql(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def listed(names: tuple[str, ...], key: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][{key} % {len(names)} + 1]"


def customers(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("k"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_acctbal").alias("x"))


CUSTOMERS = "customers AS (SELECT c_custkey AS k, 'c' || CAST(c_custkey AS VARCHAR) AS ticker, c_acctbal AS x FROM customer)"


@query(f"""WITH {CUSTOMERS}, t AS (SELECT ticker, CASE WHEN k % 11 > 0 THEN x END AS target, CASE WHEN k % 7 > 0 THEN CAST(k % 50 * 200 AS DOUBLE) END AS price, CASE WHEN k % 3 > 0 THEN k % 3 - 1 END AS upgrades FROM customers)
SELECT *, CASE WHEN target IS NULL OR price IS NULL THEN 'UNKNOWN' WHEN target >= price THEN 'CURRENT' WHEN upgrades > 0 THEN 'LIKELY_STALE_OR_LAGGING' ELSE 'POSSIBLY_STALE' END AS signal FROM t""")
def target_lag_signal(spark, sf_dir):
    k = F.col("k")
    t = customers(spark, sf_dir).select("ticker", F.when(k % 11 > 0, F.col("x")).alias("target"), F.when(k % 7 > 0, (k % 50 * 200).cast("double")).alias("price"), F.when(k % 3 > 0, k % 3 - 1).alias("upgrades"))
    return t.withColumn("signal", L.target_lag(F.col("target"), F.col("price"), F.col("upgrades")))


@query(f"""WITH {CUSTOMERS}, t AS (SELECT ticker, CASE WHEN k % 3 > 0 THEN k % 13 - 6 END AS pct_7, CASE WHEN k % 4 > 0 THEN k % 11 - 5 END AS pct_30, CASE WHEN k % 5 > 0 THEN k % 9 - 4 END AS pct_90 FROM customers)
SELECT *, CASE WHEN pct_30 <= -3 THEN 'NEGATIVE' WHEN pct_30 >= 3 THEN 'POSITIVE' WHEN pct_7 <= -3 THEN 'NEGATIVE' WHEN pct_7 >= 3 THEN 'POSITIVE' WHEN pct_30 IS NOT NULL OR pct_7 IS NOT NULL THEN 'NEUTRAL'
       WHEN pct_90 <= -3 THEN 'NEGATIVE' WHEN pct_90 >= 3 THEN 'POSITIVE' WHEN pct_90 IS NOT NULL THEN 'NEUTRAL' ELSE 'UNKNOWN' END AS signal,
       CASE WHEN abs(pct_30) < 3 AND abs(pct_7) >= 3 THEN '30d_neutral_7d' WHEN pct_30 IS NOT NULL THEN '30d' WHEN pct_7 IS NOT NULL THEN '7d' WHEN pct_90 IS NOT NULL THEN '90d_fallback' ELSE 'none' END AS driver FROM t""")
def forward_revision_signal(spark, sf_dir):
    k = F.col("k")
    t = customers(spark, sf_dir).select("ticker", *[F.when(k % null > 0, k % m - m // 2).alias(name) for name, null, m in (("pct_7", 3, 13), ("pct_30", 4, 11), ("pct_90", 5, 9))])
    signal, driver = L.forward_revision(F.col("pct_7"), F.col("pct_30"), F.col("pct_90"))
    return t.withColumn("signal", signal).withColumn("driver", driver)


SESSIONS = ("ACTIVE", "ENDED", "NOT_STARTED")


@query(f"""WITH t AS (SELECT event_id, {listed(SESSIONS, 'event_id')} AS session, CASE WHEN event_id % 5 > 0 THEN value END AS hours FROM events)
SELECT *, coalesce(CASE session WHEN 'ACTIVE' THEN hours > 2 WHEN 'ENDED' THEN hours > 12 END, true) AS stale FROM t""")
def overnight_stale(spark, sf_dir):
    t = read_table(spark, sf_dir, "events").select("event_id", pick(F.col("event_id"), SESSIONS).alias("session"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("hours"))
    return t.withColumn("stale", L.overnight_stale(F.col("session"), F.col("hours"), F.col("hours")))


KINDS = (*O.FILED, O.OWN_PAGE, O.OWN_FEED, *O.WIRE, *O.NEWS, "blog")
EVENTS = (*O.CHECKED_EVENTS, "analyst", "macro", "insider", "other")


def sources(spark, sf_dir):
    k = F.col("page_id")
    url = F.when(k % 5 == 0, "https://Finance.Yahoo.com/news/1?a=b").when(k % 7 == 0, "").otherwise(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", pick(k, KINDS).alias("kind"), (k % 3 == 0).alias("approved"), pick(k, EVENTS).alias("event"), url.alias("url"))


SOURCES_SQL = f"""sources AS (SELECT page_id, {listed(KINDS, 'page_id')} AS kind, page_id % 3 = 0 AS approved, {listed(EVENTS, 'page_id')} AS event,
    CASE WHEN page_id % 5 = 0 THEN 'https://Finance.Yahoo.com/news/1?a=b' WHEN page_id % 7 = 0 THEN '' ELSE url END AS url FROM pages)"""


@query(f"""WITH {SOURCES_SQL} SELECT page_id, CASE WHEN kind IN {in_sql(O.FILED)} THEN 'SEC_FILING' WHEN kind = 'company_ir_page' THEN 'APPROVED_IR_PAGE' WHEN kind = 'company_ir' THEN 'OFFICIAL_RSS_ATOM' WHEN kind IN {in_sql(O.WIRE)} THEN 'WIRE_RELEASE' ELSE 'CONTEXTUAL_NEWS' END AS evidence,
CASE WHEN kind IN {in_sql(O.FILED)} OR kind LIKE 'company_ir%' THEN 'OFFICIAL' WHEN coalesce(url, '') = '' THEN 'UNKNOWN' WHEN regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?[^/?#:]*(finance[.]yahoo[.]com|finnhub[.]io)([/?#:]|$)') THEN 'PROVIDER' ELSE 'PUBLISHER' END AS provenance,
CASE WHEN kind = 'sec_ex99_found' OR (kind = 'company_ir_page' AND approved) THEN 'USE_OFFICIAL_EVIDENCE' WHEN kind NOT IN {in_sql((*O.NEWS, 'blog'))} OR (kind <> 'blog' AND event IN {in_sql(O.CHECKED_EVENTS)}) THEN 'CHECK_OFFICIAL_RELEASES' ELSE 'CONTEXT_ONLY' END AS decision_use FROM sources""")
def evidence_maps(spark, sf_dir):
    kind = F.col("kind")
    return sources(spark, sf_dir).select("page_id", O.evidence_class(kind).alias("evidence"), O.url_provenance(kind, F.col("url")).alias("provenance"), O.decision_use(kind, F.col("approved"), F.col("event")).alias("decision_use"))


@query(f"""WITH {SOURCES_SQL}, g AS (SELECT page_id // 4 AS company, coalesce(bool_or(kind = 'sec_ex99_found'), false) AS has_exhibit, coalesce(bool_or(kind = 'company_ir_page' AND approved), false) AS has_page,
       count(*) FILTER (kind = 'sec_filing') AS without_exhibit, count(*) FILTER (kind IN {in_sql(O.WIRE)}) AS releases FROM sources GROUP BY 1)
SELECT company, CASE WHEN has_exhibit THEN 'SEC_EX99_RESOLVED' WHEN has_page THEN 'APPROVED_IR_PAGE_RESOLVED' WHEN without_exhibit > 0 THEN 'SEC_8K_FOUND_EX99_NOT_FOUND' WHEN releases > 0 THEN 'OFFICIAL_RELEASE_SOURCE_FOUND' ELSE 'NO_OFFICIAL_RELEASE_SOURCE' END AS status,
       has_exhibit OR has_page AS decision_grade FROM g""")
def release_coverage(spark, sf_dir):
    kind = F.col("kind")
    g = sources(spark, sf_dir).groupBy(F.expr("page_id div 4").alias("company")).agg(
        F.bool_or(kind == "sec_ex99_found").alias("has_exhibit"),
        F.bool_or((kind == O.OWN_PAGE) & F.col("approved")).alias("has_page"),
        F.count_if(kind == "sec_filing").alias("without_exhibit"),
        F.count_if(kind.isin(*O.WIRE)).alias("releases"),
    )
    status = L.release_coverage(*[F.col(c) for c in ("has_exhibit", "has_page", "without_exhibit", "releases")])
    return g.select("company", status.alias("status"), (F.col("has_exhibit") | F.col("has_page")).alias("decision_grade"))


STATES = ("FOUND_REVENUE_EXPOSURE", "NOT_DISCLOSED", "CONFLICTING", "PARSE_FAILED")


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN {listed(STATES, 'doc_id')} END AS revenue, contains(lower(coalesce(text, '')), 'the ') AS other FROM documents)
SELECT *, CASE WHEN revenue = 'FOUND_REVENUE_EXPOSURE' THEN revenue WHEN other THEN 'FOUND_NON_REVENUE_EXPOSURE' WHEN revenue IN ('NOT_DISCLOSED', 'CONFLICTING') THEN revenue ELSE 'NOT_FOUND' END AS overall FROM t""")
def exposure_overall(spark, sf_dir):
    k = F.col("doc_id")
    t = read_table(spark, sf_dir, "documents").select("doc_id", F.when(k % 5 > 0, pick(k, STATES)).alias("revenue"), F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("the ")).alias("other"))
    return t.withColumn("overall", L.exposure_overall(F.col("revenue"), F.col("other")))


UNITS = ("in Millions", "Billions and millions", "thousands of shares", "no scale")


@query(f"""WITH t AS (SELECT page_id, html || {listed(UNITS, 'page_id')} AS html FROM pages),
m AS (SELECT page_id, regexp_matches(html, '(^|[^0-9A-Za-z_])20[0-9]{{2}}([^0-9A-Za-z_]|$)') AS has_years, page_id % 3 = 0 AS has_labels,
             CASE WHEN contains(lower(html), 'billion') THEN 'billions' WHEN contains(lower(html), 'million') THEN 'millions' WHEN contains(lower(html), 'thousand') THEN 'thousands' ELSE 'unknown' END AS unit FROM t)
SELECT *, CASE WHEN has_years AND has_labels AND unit <> 'unknown' THEN 'HIGH' WHEN has_years OR has_labels THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM m""")
def table_unit_confidence(spark, sf_dir):
    html = F.concat("html", pick(F.col("page_id"), UNITS))
    m = read_table(spark, sf_dir, "pages").select("page_id", html.rlike("(^|[^0-9A-Za-z_])20[0-9]{2}([^0-9A-Za-z_]|$)").alias("has_years"), (F.col("page_id") % 3 == 0).alias("has_labels"), L.table_unit(html).alias("unit"))
    return m.withColumn("confidence", L.table_confidence(F.col("has_years"), F.col("has_labels"), F.col("unit")))


@query(f"WITH {FILINGS_SQL} SELECT filing_id, form, CASE form WHEN '10-K' THEN 'earnings' WHEN '8-K' THEN 'regulatory' WHEN '4' THEN 'insider' ELSE 'other' END AS event_type FROM filings")
def event_type_by_form(spark, sf_dir):
    return filings(spark, sf_dir).select("filing_id", "form", O.event_type_of_form(F.col("form")).alias("event_type"))


@query(f"WITH {CUSTOMERS} SELECT k, ticker FROM customers WHERE k % 7 > 0 AND k % 10 NOT IN (3, 9)")
def eligible_sources(spark, sf_dir):
    rows = customers(spark, sf_dir)
    return O.eligible(rows.select("k", "ticker"), rows.where("k % 7 = 0").select(F.upper("ticker").alias("ticker")), ("3", "9"))


@query("SELECT c_custkey AS ticker FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def any_20f(spark, sf_dir):
    tickers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"))
    forms = filings(spark, sf_dir).withColumn("form", F.when(F.col("filing_id") % 50 == 0, "20-f").otherwise(F.col("form")))
    return O.with_form(tickers, forms, "20-F")


@query(f"""WITH {CUSTOMERS}, r AS (SELECT 'C' || CAST(s_suppkey % 40 AS VARCHAR) AS entry, s_name AS page FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey % 40 ORDER BY s_suppkey DESC) = 1)
SELECT k, ticker, page FROM customers LEFT JOIN r ON upper(ticker) = entry""")
def registry_entry(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    entries = s.select(F.concat(F.lit("C"), (F.col("s_suppkey") % 40).cast("string")).alias("ticker"), (-F.col("s_suppkey")).alias("position"), F.col("s_name").alias("page"))
    return O.with_entry(customers(spark, sf_dir).select("k", "ticker"), entries)


@query(f"""WITH {FILINGS_SQL}, t AS (SELECT l_orderkey AS filing_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS shares FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
SELECT filings.*, shares, CASE WHEN shares IS NULL THEN 'FORM4_PARSE_UNAVAILABLE' END AS warning FROM filings LEFT JOIN t USING (filing_id) WHERE form = '4'""")
def insider_transactions(spark, sf_dir):
    line = read_table(spark, sf_dir, "lineitem").where("l_linenumber > 2")
    return O.with_transaction(filings(spark, sf_dir), line.groupBy(F.col("l_orderkey").alias("filing_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("shares")))


@query(f"WITH {FILINGS_SQL} SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY ticker, form ORDER BY filing_date DESC, filing_id DESC) = 2")
def nth_filing(spark, sf_dir):
    return O.nth_filing(filings(spark, sf_dir), 1)


@query("SELECT event_type AS code, 'user ' || CAST(user_id % 3 AS VARCHAR) AS message, min(event_id) AS position FROM events GROUP BY 1, 2")
def distinct_warnings(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return O.distinct_warnings(e.select(F.col("event_type").alias("code"), F.concat(F.lit("user "), (F.col("user_id") % 3).cast("string")).alias("message"), F.col("event_id").alias("position")))


@query("""SELECT c_custkey AS ticker, CASE WHEN c_custkey % 5 = 4 THEN 'part' || CAST(c_custkey % 5 AS VARCHAR) || ',none' WHEN c_custkey % 5 = 3 THEN 'part3,none' ELSE 'none' END AS invalid FROM customer""")
def invalid_sections(spark, sf_dir):
    asked = F.array(F.concat(F.lit("part"), (F.col("c_custkey") % 5).cast("string")), F.lit("risk"), F.lit("none"), F.lit("none"))
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.array_join(O.invalid_names(asked, ("part0", "part1", "part2", "risk")), ",").alias("invalid"))


@query("""WITH g AS (SELECT l_orderkey AS request_id, list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber) AS asked FROM lineitem GROUP BY 1)
SELECT request_id, array_to_string(asked[1:2], ',') AS given, array_to_string(asked[3:], ',') AS dropped, len(asked) > 2 AS truncated FROM g""")
def batch_cap(spark, sf_dir):
    line = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request_id")).agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("string"))).alias("asked"))
    given, dropped = O.capped(F.col("asked"), 2)
    return line.select("request_id", F.array_join(given, ",").alias("given"), F.array_join(dropped, ",").alias("dropped"), (F.size("asked") > 2).alias("truncated"))


@query(f"""WITH {V.GEO_SQL},
facts AS (SELECT ticker, fy AS accn, CASE WHEN region = 'AFRICA' THEN 'S-1' ELSE '10-K' END AS form, region AS concept, nation AS label, "end", CASE WHEN fy % 4 > 0 THEN cents END AS value FROM geo),
requests AS (SELECT DISTINCT ticker || '-' || CAST(fy AS VARCHAR) AS request_id, ticker, fy AS accn, CASE fy % 3 WHEN 1 THEN 'asia nation' WHEN 2 THEN 'africa' END AS topic FROM geo),
m AS (SELECT r.*, f.concept, f.label, f."end", f.value, f.form = '10-K' AND f.accn = r.accn AND (topic IS NULL OR contains(regexp_replace(lower(concept || label), '[^a-z0-9]+', '', 'g'), replace(topic, ' ', ''))) AS fits
      FROM requests r JOIN facts f USING (ticker) WHERE f.value IS NOT NULL),
b AS (SELECT * FROM m WHERE fits OR topic IS NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY fits DESC, "end" DESC, abs(value) DESC, label) = 1)
SELECT r.request_id, r.ticker, r.topic, concept, label, "end", value, fits FROM requests r LEFT JOIN b USING (request_id)""")
def fact_choice(spark, sf_dir):
    geo = V.geo_facts(spark, sf_dir)
    form = F.when(F.col("region") == "AFRICA", "S-1").otherwise("10-K")
    facts = geo.select("ticker", F.col("fy").alias("accn"), form.alias("form"), F.col("region").alias("concept"), F.col("nation").alias("label"), "end", "filed", F.when(F.col("fy") % 4 > 0, F.col("cents")).alias("value"))
    topic = F.when(F.col("fy") % 3 == 1, "asia nation").when(F.col("fy") % 3 == 2, "africa")
    name = F.concat_ws("-", "ticker", F.col("fy").cast("string"))
    requests = geo.select(name.alias("request_id"), "ticker", F.col("fy").alias("accn"), F.lit("10-K").alias("form"), topic.alias("topic")).distinct()
    return O.choose_fact(requests, facts)
