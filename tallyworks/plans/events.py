"""Queries over news items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as O
from ..sources import views as V
from .registry import Group

GROUP = Group()
query = GROUP.query

N = f"WITH {V.NEWS_SQL}"
_TERMS = " ".join(f"WHEN {' OR '.join(f'''contains(lower(coalesce(title, '')), '{t}')''' for t in terms)} THEN '{name}'" for name, terms in O.EVENT_TERMS)
TYPE = f"CASE {_TERMS} ELSE 'other' END"
_STOP = ", ".join(f"'{w}'" for w in O.STOP_TERMS)


def _words(title: str) -> str:
    return f"""list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({title}, '')), 'https?://[^ \t\n\r\f]+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '),
                       lambda w: w <> '' AND w <> lower(ticker) AND w NOT IN ({_STOP}))"""


GROUPED = f"""
stems AS (SELECT *, left(array_to_string({_words('title')}, ' '), {O.STEM_LENGTH}) AS stem FROM news),
grouped AS (SELECT * EXCLUDE (stem), left(sha256(stem || '|' || strftime(published_at, '%Y-%m-%d') || '|' || upper(trim(ticker))), 16) AS group_id FROM stems)"""


def _news(spark, sf_dir):
    return V.news(spark, sf_dir)


@query(f"{N} SELECT item_id, title, {TYPE} AS event_type FROM news")
def event_type_classify(spark, sf_dir):
    return O.classify(_news(spark, sf_dir)).select("item_id", "title", "event_type")


@query(f"{N}, {GROUPED} SELECT item_id, group_id FROM grouped")
def dedupe_group_id(spark, sf_dir):
    return O.with_group(_news(spark, sf_dir)).select("item_id", "group_id")


@query(f"""{N}, {GROUPED},
o AS (SELECT *, first(item_id) OVER w AS best, count(*) OVER (PARTITION BY group_id) AS n_items FROM grouped
      WINDOW w AS (PARTITION BY group_id ORDER BY source_rank, published_at DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
r AS (SELECT group_id, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) FILTER (item_id <> best), '') AS other_ids FROM o GROUP BY group_id)
SELECT group_id, item_id, ticker, source, title, n_items, other_ids FROM o JOIN r USING (group_id) WHERE item_id = best""")
def dedupe_keep_best(spark, sf_dir):
    return O.keep_best(_news(spark, sf_dir))


@query(f"""{N}, g AS (SELECT ticker, {", ".join(f"count(*) FILTER (source = '{s}') AS n_{s}" for s in V.SOURCES)} FROM news GROUP BY ticker)
SELECT *, concat_ws(',', {", ".join(f"CASE WHEN n_{s} = 0 THEN '{s}' END" for s in V.SOURCES)}) AS missing FROM g""")
def source_coverage(spark, sf_dir):
    return O.source_coverage(_news(spark, sf_dir), V.SOURCES)


@query(f"""{N},
t AS (SELECT item_id, ticker, source, title, concat_ws(',', CASE WHEN contains(lower(title), 'guidance') THEN 'guidance' END, CASE WHEN contains(lower(title), 'lawsuit') THEN 'lawsuit' END,
             CASE WHEN contains(lower(title), 'the ') THEN 'the ' END) AS terms
      FROM news WHERE CAST(published_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-20')
SELECT * FROM t WHERE terms <> ''""")
def event_search(spark, sf_dir):
    return O.search(_news(spark, sf_dir), ["guidance", "lawsuit", "the "], "2024-01-01", "2024-01-20")


@query(f"""{N}, p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, item_id) AS position FROM news)
SELECT ticker, CAST(position AS INTEGER) AS position, item_id, CAST(published_at AS DATE) AS day, {TYPE} AS event_type, source FROM p WHERE position <= 10""")
def event_timeline(spark, sf_dir):
    return O.timeline(_news(spark, sf_dir), 10)


@query(f"""{N},
claims AS (SELECT item_id AS claim_id, ticker, title AS text, DATE '2024-01-02' AS "start", DATE '2024-01-03' AS "end" FROM news),
c AS (SELECT *, list_distinct({_words('text')}) AS cw FROM claims),
n AS (SELECT ticker, source_rank, CAST(published_at AS DATE) AS day, list_distinct({_words('title')}) AS words FROM news),
s AS (SELECT claim_id, source_rank, day BETWEEN "start" AND "end" AS inside, day < DATE '2024-05-01' - 90 AS old,
             len(cw) > 0 AND len(list_intersect(cw, words)) >= CASE WHEN len(cw) <= 2 THEN len(cw) ELSE ceil(0.67e0 * len(cw)) END AS ok
      FROM c LEFT JOIN n USING (ticker)),
g AS (SELECT claim_id, count(*) FILTER (ok AND inside AND source_rank = 0) AS official, count(*) FILTER (ok AND inside) AS in_window, count(*) FILTER (ok) AS support, count(*) FILTER (ok AND old) AS old
      FROM s GROUP BY claim_id)
SELECT *, CASE WHEN official > 0 THEN 'CONFIRMED' WHEN in_window > 0 THEN 'PARTIAL' WHEN support > 0 AND support = old THEN 'STALE' ELSE 'NOT_FOUND' END AS status FROM g""")
def event_verify_tokens(spark, sf_dir):
    news = _news(spark, sf_dir)
    claims = news.select(F.col("item_id").alias("claim_id"), "ticker", F.col("title").alias("text"), F.lit("2024-01-02").cast("date").alias("start"), F.lit("2024-01-03").cast("date").alias("end"))
    return O.verify(claims, news, "2024-05-01")


@query(f"""{N}, {GROUPED},
disputed AS (SELECT group_id FROM grouped GROUP BY group_id HAVING count(DISTINCT source_rank) > 1),
claims AS (SELECT item_id AS claim_id, ticker, title || CASE WHEN item_id % 4 = 1 THEN ' absent1 absent2 absent3 absent4 absent5 absent6 absent7 absent8 absent9 absent10 absent11 absent12 absent13' ELSE '' END AS text,
           DATE '2024-01-02' AS "start", DATE '2024-01-03' AS "end" FROM news),
c AS (SELECT *, list_distinct({_words('text')}) AS cw FROM claims),
n AS (SELECT ticker, source_rank, CAST(published_at AS DATE) AS day, list_distinct({_words('title')}) AS words, group_id IN (SELECT group_id FROM disputed) AS conflicting FROM grouped),
s AS (SELECT claim_id, ticker, source_rank, conflicting, day BETWEEN "start" AND "end" AS inside, day < DATE '2024-05-01' - 90 AS old,
             len(cw) > 0 AND len(list_intersect(cw, words)) >= CASE WHEN len(cw) <= 2 THEN len(cw) ELSE ceil(0.67e0 * len(cw)) END AS ok
      FROM c LEFT JOIN n USING (ticker)),
g AS (SELECT claim_id, ticker, count(*) FILTER (ok AND inside AND source_rank = 0) AS official, count(*) FILTER (ok AND inside) AS in_window, count(*) FILTER (ok) AS support, count(*) FILTER (ok AND old) AS old,
             count(*) FILTER (ok AND conflicting) AS conflicts FROM s GROUP BY claim_id, ticker)
SELECT * EXCLUDE (ticker), CASE WHEN conflicts > 0 THEN 'CONFLICTING' WHEN official > 0 THEN 'CONFIRMED' WHEN in_window > 0 THEN 'PARTIAL' WHEN support > 0 AND support = old THEN 'STALE'
       WHEN CAST(substr(ticker, 2) AS INTEGER) % 5 = 0 THEN 'SOURCE_LIMITED_NOT_FOUND' ELSE 'NOT_FOUND' END AS status FROM g""")
def event_verify_states(spark, sf_dir):
    news = _news(spark, sf_dir)
    absent = F.when(F.col("item_id") % 4 == 1, " " + " ".join(f"absent{i}" for i in range(1, 14))).otherwise("")
    claims = news.select(F.col("item_id").alias("claim_id"), "ticker", F.concat("title", absent).alias("text"), F.lit("2024-01-02").cast("date").alias("start"), F.lit("2024-01-03").cast("date").alias("end"))
    disputed = O.with_group(news).groupBy("group_id").agg(F.count_distinct("source_rank").alias("n")).where("n > 1")
    limited = news.where("cast(substr(ticker, 2) as int) % 5 = 0").select("ticker").distinct()
    return O.verify(claims, news, "2024-05-01", disputed, limited)


#: Of the official items, whose ids four divides, a quarter names the ticker, a quarter another one and a quarter the company.
NAMED = "title || CASE item_id % 16 WHEN 4 THEN ' (' || ticker || ')' WHEN 8 THEN ' X' || ticker WHEN 12 THEN ' at Northern Registry' ELSE '' END"


@query(f"""{N},
told AS (SELECT * REPLACE ({NAMED} AS title) FROM news),
claims AS (SELECT item_id AS claim_id, ticker, title AS text, DATE '2024-01-02' AS "start", DATE '2024-01-20' AS "end" FROM news),
c AS (SELECT *, list_distinct({_words('text')}) AS cw FROM claims),
n AS (SELECT ticker, source_rank, CAST(published_at AS DATE) AS day, list_distinct({_words('title')}) AS words,
             regexp_matches(lower(title), '(^|[^a-z0-9])' || lower(ticker) || '([^a-z0-9]|$)') OR contains(lower(title), 'northern registry') AS named FROM told),
s AS (SELECT claim_id, source_rank, named, day BETWEEN "start" AND "end" AS inside, day < DATE '2024-05-01' - 90 AS old,
             len(cw) > 0 AND len(list_intersect(cw, words)) >= CASE WHEN len(cw) <= 2 THEN len(cw) ELSE ceil(0.67e0 * len(cw)) END AS ok
      FROM c LEFT JOIN n USING (ticker)),
g AS (SELECT claim_id, count(*) FILTER (ok AND inside AND source_rank = 0) AS official, count(*) FILTER (ok AND inside) AS in_window, count(*) FILTER (ok) AS support, count(*) FILTER (ok AND old) AS old,
             count(*) FILTER (ok AND inside AND source_rank = 0 AND named) AS naming FROM s GROUP BY claim_id)
SELECT *, CASE WHEN naming > 0 THEN 'CONFIRMED' WHEN in_window > 0 THEN 'PARTIAL' WHEN support > 0 AND support = old THEN 'STALE' ELSE 'NOT_FOUND' END AS status FROM g""")
def event_verify_relevance(spark, sf_dir):
    news = _news(spark, sf_dir)
    claims = news.select(F.col("item_id").alias("claim_id"), "ticker", F.col("title").alias("text"), F.lit("2024-01-02").cast("date").alias("start"), F.lit("2024-01-20").cast("date").alias("end"))
    names = news.select("ticker", F.lit("Northern Registry").alias("company")).distinct()
    return O.verify(claims, news.withColumn("title", F.expr(NAMED)), "2024-05-01", names=names)


@query(f"""{N}, w AS (SELECT item_id, ticker, published_at, list_distinct({_words('title')}) AS words FROM news),
p AS (SELECT item_id, words, lag(item_id) OVER o AS before_id, lag(words) OVER o AS before FROM w WINDOW o AS (PARTITION BY ticker ORDER BY published_at, item_id))
SELECT item_id, before_id, len(list_intersect(words, before)) / nullif(len(list_distinct(list_concat(words, before))), 0) AS jaccard FROM p WHERE before_id IS NOT NULL""")
def title_overlap_jaccard(spark, sf_dir):
    return O.title_overlap(_news(spark, sf_dir))


@query(f"""{N}, t AS (SELECT item_id, title || ' ' || ['TSXV:MRVL', 'NASDAQ:MRVL', 'MRVL', 'XMRVL'][item_id % 4 + 1] || ' rises' AS title FROM news)
SELECT item_id, item_id % 4 IN (1, 2) AS mentioned FROM t""")
def ticker_context_match(spark, sf_dir):
    forms = F.array(*[F.lit(x) for x in ("TSXV:MRVL", "NASDAQ:MRVL", "MRVL", "XMRVL")])
    title = F.concat(F.col("title"), F.lit(" "), F.element_at(forms, (F.col("item_id") % 4 + 1).cast("int")), F.lit(" rises"))
    return _news(spark, sf_dir).select("item_id", O.mentions_ticker(title, "MRVL", ("NASDAQ", "NYSE")).alias("mentioned"))
