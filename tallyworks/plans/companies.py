"""Queries over company profiles, identities and filings' parts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import companies as O
from ..operators import filings as P
from ..operators import sections as S
from ..operators.regions import region_revenue
from ..sources import views as V
from ..sources.tables import read_table
from ..streaming import windows as W
from .documents import RELEASE_SQL, TEXT, pages, releases, texts
from .facts import FILINGS_SQL, filings
from .registry import Group

GROUP = Group()
query = GROUP.query

PROFILES_SQL = """
profiles AS (
    SELECT c_custkey AS ticker, c_name AS long_name, c_mktsegment AS sector, c_nationkey AS country, CASE c_custkey % 3 WHEN 0 THEN 'EQUITY' WHEN 1 THEN 'ETF' ELSE 'MUTUALFUND' END AS quote_type,
           c_acctbal AS market_cap, c_custkey % 17 AS total_assets, c_custkey % 5 AS fund_rating FROM customer)"""
GROUPS = {"identity": ["long_name", "sector", "country"], "pricing": ["market_cap"]}


def profiles(spark, sf_dir):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "EQUITY").when(k % 3 == 1, "ETF").otherwise("MUTUALFUND")
    c = read_table(spark, sf_dir, "customer")
    return c.select(k.alias("ticker"), F.col("c_name").alias("long_name"), F.col("c_mktsegment").alias("sector"), F.col("c_nationkey").alias("country"), kind.alias("quote_type"), F.col("c_acctbal").alias("market_cap"), (k % 17).alias("total_assets"), (k % 5).alias("fund_rating"))


@query(f"WITH {PROFILES_SQL} SELECT ticker, long_name, sector, country, market_cap FROM profiles")
def profile_field_groups(spark, sf_dir):
    return O.select_fields(profiles(spark, sf_dir), ["identity", "pricing", "sector"], GROUPS)


@query(f"WITH {PROFILES_SQL} SELECT * REPLACE (CASE WHEN quote_type <> 'EQUITY' THEN total_assets END AS total_assets, CASE WHEN quote_type <> 'EQUITY' THEN fund_rating END AS fund_rating) FROM profiles")
def equity_field_drop(spark, sf_dir):
    return O.without_fund_fields(profiles(spark, sf_dir), ["total_assets", "fund_rating"])


@query("""WITH s AS (SELECT o_custkey AS ticker, count(*) AS shares_short, count(*) FILTER (o_orderstatus = 'F') * 3 AS shares_short_prior, (o_custkey % 45) / 1e2 AS short_pct_float, o_custkey % 6 AS short_ratio FROM orders GROUP BY o_custkey),
m AS (SELECT ticker, short_pct_float * 100 AS short_pct, short_ratio, (shares_short - shares_short_prior) / nullif(shares_short_prior, 0) * 100 AS mom_change_pct FROM s)
SELECT ticker, short_pct, mom_change_pct, CASE WHEN abs(mom_change_pct) < 2 THEN 'FLAT' WHEN mom_change_pct > 0 THEN 'RISING' WHEN mom_change_pct IS NOT NULL THEN 'FALLING' END AS mom_direction,
       CASE WHEN short_pct > 30 AND short_ratio < 3 THEN 'HIGH' WHEN short_pct > 20 THEN 'MODERATE' ELSE 'LOW' END AS squeeze_risk, CASE WHEN short_pct > 30 THEN 'CRITICAL' WHEN short_pct > 20 THEN 'HIGH' END AS flag FROM m""")
def short_momentum(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.count("*").alias("shares_short"), (F.count_if(F.col("o_orderstatus") == "F") * 3).alias("shares_short_prior"))
    return O.short_momentum(o.withColumn("short_pct_float", (F.col("ticker") % 45) / 100.0).withColumn("short_ratio", F.col("ticker") % 6))


@query(f"WITH {PROFILES_SQL} SELECT ticker, long_name, market_cap FROM profiles WHERE market_cap >= 5000 ORDER BY market_cap DESC NULLS LAST, ticker LIMIT 25")
def screen_topk(spark, sf_dir):
    return O.screen(profiles(spark, sf_dir).select("ticker", "long_name", "market_cap"), "large")


NAMES = ("Alpha Bravo Company", "Delta Echo and Foxtrot Group Inc", "Sierra Tango Uniform Ltd", "Zulu")


@query(f"""WITH {V.NEWS_SQL},
t AS (SELECT item_id, ticker, title || ' ' || ['Alpha, Bravo!', 'D.E.F. up DEF', 'sierra tango uniform ltd', 'T3 rises', 'nobody'][item_id % 5 + 1] AS title, CAST(substr(ticker, 2) AS INTEGER) % 4 AS k FROM news),
p AS (SELECT *, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS plain, ' ' || regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g') || ' ' AS words FROM t)
SELECT item_id, ticker, title, CASE WHEN contains(words, ' ' || upper(ticker) || ' ') THEN 'TICKER_TOKEN'
       WHEN (k = 0 AND contains(plain, ' alpha bravo ')) OR (k = 1 AND contains(plain, ' delta echo and foxtrot ')) OR (k = 2 AND contains(plain, ' sierra tango uniform ')) OR (k = 3 AND contains(plain, ' zulu ')) THEN 'ISSUER_NAME'
       WHEN (k = 1 AND contains(plain, ' def ')) OR (k = 2 AND contains(plain, ' stu ')) THEN 'ISSUER_ACRONYM' END AS match FROM p""")
def issuer_match(spark, sf_dir):
    forms = F.array(*[F.lit(x) for x in ("Alpha, Bravo!", "D.E.F. up DEF", "sierra tango uniform ltd", "T3 rises", "nobody")])
    news = V.news(spark, sf_dir).withColumn("title", F.concat("title", F.lit(" "), F.element_at(forms, (F.col("item_id") % 5 + 1).cast("int"))))
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.substring("ticker", 2, 9).cast("int") % 4 + 1)
    return O.match_issuer(news, news.select("ticker").distinct().withColumn("name", name))


@query("""SELECT n_nationkey, n_name, list_contains(list_transform(string_split('NYSE:' || n_name || ', TSX: NATION_3,nation_4', ','), lambda c: upper(trim(split_part(c, ':', -1)))), 'NATION_3') AS named FROM nation""")
def rss_category_match(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    return n.select("n_nationkey", "n_name", O.has_category(F.concat(F.lit("NYSE:"), "n_name", F.lit(", TSX: NATION_3,nation_4")), F.lit("nation_3")).alias("named"))


@query("""SELECT c_custkey AS ticker, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 100 END, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 200 END, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 300 END) AS cik,
CASE WHEN c_custkey % 2 = 0 THEN 'info' WHEN c_custkey % 3 = 0 THEN 'map' WHEN c_custkey % 5 = 0 THEN 'feed' ELSE 'NOT_FOUND' END AS source FROM customer""")
def cik_fallback(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"))
    step = lambda n, add: c.where(F.col("ticker") % n == 0).withColumn("cik", F.col("ticker") + add)
    return O.resolve_cik(c, [("info", step(2, 100)), ("map", step(3, 200)), ("feed", step(5, 300))])


@query(f"""WITH {FILINGS_SQL},
e AS (SELECT l_orderkey AS filing_id, ['EX-99.1', 'EX-99', 'EX-10', 'EX-99.01'][l_linenumber % 4 + 1] AS exhibit_type, min(l_partkey) AS sequence FROM lineitem GROUP BY ALL),
b AS (SELECT * FROM e WHERE exhibit_type <> 'EX-10' QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY CASE exhibit_type WHEN 'EX-99.1' THEN 1 WHEN 'EX-99.01' THEN 2 ELSE 3 END, sequence) = 1)
SELECT filing_id, ticker, filing_date, form, exhibit_type, sequence FROM filings LEFT JOIN b USING (filing_id) WHERE form = '8-K'""")
def exhibit_enrichment(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("EX-99.1", "EX-99", "EX-10", "EX-99.01")])
    line = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("filing_id"), F.element_at(kinds, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("exhibit_type"), "l_partkey")
    exhibits = line.groupBy("filing_id", "exhibit_type").agg(F.min("l_partkey").alias("sequence"))
    return O.with_exhibit(filings(spark, sf_dir).where("form = '8-K'"), exhibits, ("EX-99.1", "EX-99.01", "EX-99"))


@query(f"""{TEXT}, s AS (SELECT doc_id, 'part ' || CAST(i - 1 AS VARCHAR) AS section, lower(p) AS p FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS p, generate_subscripts(string_split(text, '. '), 1) AS i FROM plain)),
t AS (SELECT doc_id, section, term, len(string_split(p, term)) - 1 AS n FROM s CROSS JOIN (SELECT unnest(['tion', 'und', 'absent term']) AS term))
SELECT doc_id, term, count(*) AS n_sections, CAST(sum(n) AS BIGINT) AS n_mentions, min(section) AS first_section FROM t WHERE n > 0 GROUP BY doc_id, term""")
def exposure_mentions(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "[.] ")).alias("i", "text"))
    return P.topic_mentions(rows.withColumn("section", F.concat(F.lit("part "), F.col("i").cast("string"))), ["tion", "und", "Absent term".lower()])


@query(f"""WITH {RELEASE_SQL}, t AS (SELECT unnest(['expects', 'sales between', 'margin']) AS topic),
s AS (SELECT doc_id, topic, list_filter(string_split(regexp_replace(text, '([.!?])[ ]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: contains(lower(x), topic))[1] AS summary FROM releases CROSS JOIN t)
SELECT *, CASE WHEN summary IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status FROM s""")
def management_commentary(spark, sf_dir):
    return P.commentary(releases(spark, sf_dir), ["expects", "sales between", "margin"])


CLEAN = r"regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b[^>]*>.*?</\s*script[^>]*>|<style\b[^>]*>.*?</\s*style[^>]*>', '', 'gis'), '\s+on\w+=(\"[^\"]*\"|''[^'']*''|[^\s>]+)', ' ', 'gi')"
CONTENTS = "<h1>Contents</h1><p><a href='#r'>Risk factors</a></p><h2><a href='#r'>Risk factors</a></h2><h2>Risk factors . . . . 7</h2>"
ONE = "<h2 id='r'>Risk <i>factors</i></h2><p>text</p><h3>Deeper</h3>"
ITEMS = "<p><a href='#i'><b>Item 1A</b></a></p><p><b>Item 1A</b>. Risks</p><p>t</p><p>see <b>Item 1AB</b></p>"
LAST_ITEM = "<p><span style='font-weight: bold'>ITEM 2</span></p>"
SECTIONED = (CONTENTS + ONE + "<h2>Next</h2>", CONTENTS + ONE + ONE + "<h2>Next</h2>", ITEMS + LAST_ITEM, "<p>nothing</p>")


def sectioned_pages(spark, sf_dir):
    """The pages with sections of four shapes behind them."""
    shape = F.element_at(F.array(*[F.lit(s) for s in SECTIONED]), (F.col("doc_id") % 4 + 1).cast("int"))
    return pages(spark, sf_dir).select("doc_id", F.concat("html", shape).alias("html"))


@query(f"""WITH p AS (SELECT page_id AS doc_id, length({CLEAN}) AS size FROM pages)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN size + {len(CONTENTS)} END AS start, CASE WHEN doc_id % 4 = 0 THEN size + {len(CONTENTS + ONE)} END AS "end", CASE doc_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS status FROM p""")
def section_bounds(spark, sf_dir):
    return S.section_bounds(sectioned_pages(spark, sf_dir), "risk factors")


@query(f"""WITH p AS (SELECT page_id AS doc_id, length({CLEAN}) AS size FROM pages)
SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN size + {ITEMS.index("<b>Item 1A</b>. Risks")} END AS start, CASE WHEN doc_id % 4 = 2 THEN size + {ITEMS.index("<b>Item 1AB")} END AS "end", CASE doc_id % 4 WHEN 2 THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM p""")
def item_bounds(spark, sf_dir):
    return S.section_bounds(sectioned_pages(spark, sf_dir), "Item 1A")


@query("""SELECT s_suppkey AS doc_id, CAST(s_suppkey + 10 AS DOUBLE) * 1e6 AS region_revenue, CAST(s_suppkey + 10 + 200 AS DOUBLE) * 1e6 AS total_revenue,
round(CAST(s_suppkey + 10 AS DOUBLE) / CAST(s_suppkey + 10 + 200 AS DOUBLE), 4) AS ratio FROM supplier""")
def region_revenue_html(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    number = lambda c: c.cast("string")
    html = F.concat(F.lit("<p>in millions</p><table><tr><th>Region</th><th>2024</th></tr><tr><td>China (1)</td><td>$ "), number(F.col("s_suppkey") + 10), F.lit("</td></tr><tr><td>Europe</td><td>200</td></tr><tr><td>Total</td><td>"), number(F.col("s_suppkey") + 210), F.lit("</td></tr></table>"))
    found = region_revenue(s.select(F.col("s_suppkey").alias("doc_id"), html.alias("html")), ["China"])
    return found.select("doc_id", "region_revenue", "total_revenue", "ratio")


def _streamed(stream, name, mode="append"):
    """A bounded run over what there is; rows and state go to a new folder where the cluster keeps checkpoints."""
    context = stream.sparkSession.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir: a folder that all executors share is needed on a cluster")
    folder = f"{shared}/{name}-{uuid.uuid4()}" if shared else tempfile.mkdtemp(prefix=name)
    return W.run_available(stream, folder, mode)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_watermark(spark, sf_dir):
    once = W.without_repeats(W.event_stream(spark, sf_dir), ["user_id", "event_type"], "60 days")
    return _streamed(once.select("user_id", "event_type"), "stream_dedupe_watermark")


@query("""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    rows = W.tumbling_counts(W.event_stream(spark, sf_dir), "1 day")
    return _streamed(rows, "stream_windows", "complete").select(F.to_date("start").alias("day"), "event_type", "n", "cents")


@query("SELECT user_id, 1 AS readings, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id")
def stream_flow_state(spark, sf_dir):
    rows = _streamed(W.flow_state(W.event_stream(spark, sf_dir)), "stream_flow_state")
    return rows.select("user_id", F.col("readings").cast("int").alias("readings"), F.round(F.col("volume") * 100).cast("long").alias("cents"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "start", strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")]
    return W.sessions(events).select("user_id", *times, "n")
