"""Queries over structured facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allow_lists as L
from ..operators import facts as O
from ..operators.totals import with_total
from ..sources import views as V
from ..sources.tables import read_table
from .registry import Group

GROUP = Group()
query = GROUP.query

G = f"WITH {V.GEO_SQL}"
FORMS = ("10-K", "10-K/A", "8-K", "SC 13G", "4", "S-8", "DEF 14A")
_FORM_LIST = "[" + ", ".join(f"'{f}'" for f in FORMS) + "]"
FILINGS_SQL = f"filings AS (SELECT o_orderkey AS filing_id, o_custkey AS ticker, CAST(o_orderdate AS DATE) AS filing_date, {_FORM_LIST}[o_orderkey % 7 + 1] AS form FROM orders)"


def filings(spark, sf_dir):
    forms = F.array(*[F.lit(f) for f in FORMS])
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("filing_date"), F.element_at(forms, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("form"))


@query(f"{G}, s AS (SELECT ticker, fy, region, CAST(sum(cents) AS BIGINT) AS amount FROM geo GROUP BY ALL), t AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY ticker, fy) AS BIGINT) AS total FROM s) SELECT *, amount / nullif(total, 0) AS share FROM t")
def geo_revenue_share(spark, sf_dir):
    return O.share_of_total(V.geo_facts(spark, sf_dir), ["ticker", "fy"], "region", "cents")


@query(f"{G}, s AS (SELECT fy, ticker, CAST(sum(cents) AS BIGINT) AS amount FROM geo GROUP BY ALL), t AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY fy) AS BIGINT) AS total FROM s) SELECT *, amount / nullif(total, 0) AS share FROM t")
def segment_revenue(spark, sf_dir):
    return O.share_of_total(V.geo_facts(spark, sf_dir), ["fy"], "ticker", "cents")


@query(f"""{G}, s AS (SELECT ticker, fy, nation, CAST(sum(cents) AS BIGINT) AS amount FROM geo GROUP BY ALL),
t AS (SELECT *, amount / sum(amount) OVER (PARTITION BY ticker, fy) AS share FROM s)
SELECT ticker, fy, first(nation ORDER BY amount DESC, nation DESC) AS largest, max(share) AS largest_share, count(*) FILTER (share >= 0.05) AS n_large, round(sum(share * share), 9) AS hhi FROM t GROUP BY ticker, fy""")
def customer_concentration(spark, sf_dir):
    return O.concentration(V.geo_facts(spark, sf_dir), ["ticker", "fy"], "nation", "cents", 0.05)


@query(f"""{G}, f AS (SELECT ticker, CASE WHEN region = 'ASIA' THEN 'Revenues' WHEN region = 'EUROPE' THEN 'SalesRevenueNet' ELSE 'Other' END AS concept, "end", filed, cents FROM geo),
s AS (SELECT ticker, concept, "end", filed, CAST(sum(cents) AS BIGINT) AS value FROM f GROUP BY ALL)
SELECT ticker, concept, "end", value FROM s WHERE concept <> 'Other'
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY CASE concept WHEN 'SalesRevenueNet' THEN 1 ELSE 2 END, "end" DESC, filed DESC) = 1""")
def xbrl_latest_annual(spark, sf_dir):
    concept = F.when(F.col("region") == "ASIA", "Revenues").when(F.col("region") == "EUROPE", "SalesRevenueNet").otherwise("Other")
    facts = V.geo_facts(spark, sf_dir).groupBy("ticker", concept.alias("concept"), "end", "filed").agg(F.sum("cents").alias("value"))
    return O.latest_annual(facts, ["SalesRevenueNet", "Revenues"])


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) AS start, CAST(l_shipdate AS DATE) AS "end" FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT *, CAST("end" - start AS INTEGER) AS days FROM f)
SELECT *, CASE WHEN days BETWEEN 60 AND 110 THEN 'quarterly' WHEN days BETWEEN 340 AND 400 THEN 'annual' ELSE 'other' END AS band FROM b""")
def period_band_filter(spark, sf_dir):
    line, o = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    facts = line.join(o, line["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("o_orderdate").alias("start"), F.to_date("l_shipdate").alias("end"))
    return O.period_band(facts)


@query(f"""WITH {FILINGS_SQL}, facts AS (SELECT o_custkey AS ticker, CAST(l_shipdate AS DATE) AS filed FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT filing_id, count(*) AS n_facts, min(filed) AS first_filed FROM filings JOIN facts USING (ticker) WHERE abs(filed - filing_date) <= 10 GROUP BY filing_id)
SELECT filing_id, ticker, filing_date, form, coalesce(n_facts, 0) AS n_facts, first_filed FROM filings LEFT JOIN n USING (filing_id)""")
def interval_join_10d(spark, sf_dir):
    line, o = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    facts = line.join(o, line["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("ticker"), F.to_date("l_shipdate").alias("filed"))
    return O.near_filing(facts, filings(spark, sf_dir))


@query(f"WITH {FILINGS_SQL} SELECT * FROM filings WHERE form NOT IN ('4', 'SC 13G') AND (starts_with(form, '10-K') OR starts_with(form, '8-K') OR starts_with(form, 'DEF'))")
def material_filings_prefix(spark, sf_dir):
    return O.material_filings(filings(spark, sf_dir), ("4", "SC 13G"), ("10-K", "8-K", "DEF"))


@query(f"WITH {FILINGS_SQL} SELECT * FROM filings WHERE filing_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND filing_date >= DATE '1999-12-31' - 500")
def date_window_filter(spark, sf_dir):
    return O.in_window(filings(spark, sf_dir), "filing_date", "1997-01-01", "1999-12-31", 500, "1999-12-31")


@query(f"WITH {FILINGS_SQL}, c AS (SELECT *, count(*) FILTER (form = '10-K') OVER (PARTITION BY ticker) AS n FROM filings) SELECT filing_id, ticker, filing_date, form FROM c WHERE form = '10-K' OR n = 0")
def soft_filter_fallback(spark, sf_dir):
    return O.soft_filter(filings(spark, sf_dir), "ticker", F.col("form") == "10-K")


@query(f"""WITH {FILINGS_SQL} SELECT CAST(ticker AS VARCHAR) AS cik, CAST(row_number() OVER (PARTITION BY ticker ORDER BY filing_id) - 1 AS INTEGER) AS position, form, filing_date, filing_id AS accession FROM filings""")
def filings_from_arrays(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct("filing_id", "form", "filing_date")))
    packed = filings(spark, sf_dir).groupBy(F.col("ticker").cast("string").alias("cik")).agg(ordered.alias("f"))
    return O.filings_from_arrays(packed.select("cik", F.col("f.form").alias("form"), F.col("f.filing_date").alias("filing_date"), F.col("f.filing_id").alias("accession")))


@query("""
WITH r AS (SELECT o_orderkey AS fact_id, o_custkey AS ticker, 'Revenues' AS concept, 'A' || o_orderkey AS accn, CAST(o_orderdate AS DATE) AS "end", CAST(o_orderdate AS DATE) + 45 AS filed, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders),
t AS (SELECT fact_id AS total_id, ticker, CASE fact_id % 5 WHEN 0 THEN accn ELSE 'B' || fact_id END AS accn, CASE WHEN fact_id % 5 = 2 THEN "end" + 200 ELSE "end" END AS "end", CASE WHEN fact_id % 5 = 2 THEN filed + CAST(fact_id % 9 AS INTEGER) ELSE filed END AS filed, value * 4 AS total FROM r WHERE fact_id % 5 < 3),
m AS (SELECT r.fact_id, t.total_id, t.total, t."end" AS e, t.filed AS f, abs(t.filed - r.filed) AS apart, CASE WHEN t.accn = r.accn THEN 0 WHEN t."end" = r."end" THEN 1 WHEN apart <= 10 THEN 2 ELSE 3 END AS kind FROM r JOIN t USING (ticker)),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY kind, CASE WHEN kind = 2 THEN apart ELSE 0 END, e DESC, f DESC, total_id) = 1)
SELECT fact_id, ticker, concept, accn, "end", filed, value, total_id, total, ['accession', 'period', 'near date', 'any'][kind + 1] AS matched_by, CASE WHEN total > 0 THEN round(value / total, 4) END AS ratio FROM r LEFT JOIN b USING (fact_id)""")
def totals_by_ranked_keys(spark, sf_dir):
    k, cents = F.col("fact_id"), F.round(F.col("o_totalprice") * 100).cast("long")
    end = F.to_date("o_orderdate")
    regional = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("ticker"), F.lit("Revenues").alias("concept"), F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("accn"), end.alias("end"), F.date_add(end, 45).alias("filed"), cents.alias("value"))
    other = F.when(k % 5 == 0, F.col("accn")).otherwise(F.concat(F.lit("B"), k.cast("string")))
    late = k % 5 == 2
    totals = regional.where(k % 5 < 3).select(k.alias("total_id"), "ticker", "concept", other.alias("accn"), F.when(late, F.date_add("end", 200)).otherwise(F.col("end")).alias("end"), F.when(late, F.date_add("filed", (k % 9).cast("int"))).otherwise(F.col("filed")).alias("filed"), (F.col("value") * 4).alias("value"))
    return with_total(regional, totals)


URL_PARTS_SQL = """
u AS (SELECT page_id AS id, url, lower(split_part(url, '://', 1)) AS scheme, regexp_extract(split_part(url, '://', 2), '^([^/?#]*)([^?#]*)', 1) AS full_host, regexp_extract(split_part(url, '://', 2), '^([^/?#]*)([^?#]*)', 2) AS path, regexp_replace(lower(full_host), '^www[.]', '') AS host FROM pages),
rules AS (
    SELECT id AS rule_id, CASE WHEN id % 4 = 0 THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE host END AS host, CASE WHEN id % 2 = 0 THEN '/' || split_part(path, '/', 2) || '/' ELSE left(path, 6) END AS prefix, id % 4 = 0 AS subdomains
    FROM u WHERE id % 3 = 0)"""


@query(f"""WITH {URL_PARTS_SQL},
m AS (SELECT u.id, rule_id, starts_with(path, prefix) AS fits, length(r.host) AS host_size, length(prefix) AS prefix_size FROM u JOIN rules r ON u.host = r.host OR (subdomains AND ends_with(u.host, '.' || r.host))),
b AS (SELECT id, arg_min(rule_id, (-host_size, -prefix_size, rule_id)) FILTER (fits) AS rule_id FROM m GROUP BY id)
SELECT id, url, scheme, host, path, CASE WHEN scheme = 'https' THEN rule_id END AS rule_id, CASE WHEN scheme <> 'https' THEN 'SCHEME' WHEN rule_id IS NOT NULL THEN 'ALLOWED' WHEN b.id IS NOT NULL THEN 'PATH' ELSE 'HOST' END AS status FROM u LEFT JOIN b USING (id)""")
def url_allow_list(spark, sf_dir):
    urls = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    k, parts = F.col("id"), L.url_parts(F.col("url")).alias("u")
    labels = F.split("u.host", r"\.")
    domain = F.array_join(F.slice(labels, -3, 3), ".")
    prefix = F.when(k % 2 == 0, F.concat(F.lit("/"), F.split_part(F.col("u.path"), F.lit("/"), F.lit(2)), F.lit("/"))).otherwise(F.left("u.path", F.lit(6)))
    rules = urls.where(k % 3 == 0).select("id", parts).select(k.alias("rule_id"), F.when(k % 4 == 0, domain).otherwise(F.col("u.host")).alias("host"), prefix.alias("prefix"), (k % 4 == 0).alias("subdomains"))
    return L.allowed_urls(urls, rules)


@query("SELECT event_id, event_type AS content_type, CASE WHEN event_type NOT IN (SELECT event_type FROM events GROUP BY event_type ORDER BY event_type LIMIT 3) THEN 'CONTENT_TYPE' END AS rejected FROM events")
def content_type_filter(spark, sf_dir):
    items = read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("content_type"))
    listed = items.select(F.upper("content_type").alias("content_type")).distinct().orderBy("content_type").limit(3)
    return L.content_allowed(items, listed)
