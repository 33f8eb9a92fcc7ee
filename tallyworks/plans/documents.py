"""Queries over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as O
from ..operators import filing_index as X
from ..sources.tables import read_table
from .registry import Group

GROUP = Group()
query = GROUP.query

SPACES = "[ \t\n\r\f\x0b]+"
STRIP = rf"trim(regexp_replace(regexp_replace(regexp_replace({{0}}, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '{SPACES}', ' ', 'g'))"
TEXT = f"WITH plain AS (SELECT page_id AS doc_id, {STRIP.format('html')} AS text FROM pages)"
RELEASE_SQL = """
releases AS (
    SELECT o_orderkey AS doc_id, 'Fiscal ' || CAST(year(o_orderdate) + 25 AS VARCHAR) || ['', ' First Quarter', ' Second Quarter', ' Third Quarter', ' Fourth Quarter'][o_orderkey % 5 + 1]
           || ' results. The company expects revenue of $' || CAST(o_custkey AS VARCHAR) || ' million. Revenue was $' || CAST(o_custkey % 90 + 10 AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR)
           || ' million, up. We see sales between $1,' || CAST(o_orderkey % 900 + 100 AS VARCHAR) || ' and $' || CAST(o_orderkey % 7 + 2 AS VARCHAR) || ',000 thousand.' AS text
    FROM orders)"""


def pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", "html")


def texts(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", O.strip_html(F.col("html")).alias("text"))


def releases(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    s = lambda c: c.cast("string")
    quarters = F.array(*[F.lit(x) for x in ("", " First Quarter", " Second Quarter", " Third Quarter", " Fourth Quarter")])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.lit("Fiscal "), s(F.year("o_orderdate") + 25), F.element_at(quarters, (k % 5 + 1).cast("int")), F.lit(" results. The company expects revenue of $"), s(c), F.lit(" million. Revenue was $"), s(c % 90 + 10), F.lit("."), s(k % 10),
        F.lit(" million, up. We see sales between $1,"), s(k % 900 + 100), F.lit(" and $"), s(k % 7 + 2), F.lit(",000 thousand."),
    )
    return o.select(k.alias("doc_id"), text.alias("text"))


@query(f"{TEXT} SELECT * FROM plain")
def strip_html(spark, sf_dir):
    return texts(spark, sf_dir)


@query(f"{TEXT} SELECT doc_id, text, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words FROM plain")
def page_word_counts(spark, sf_dir):
    return O.concept_columns(pages(spark, sf_dir))


@query(rf"""WITH h AS (SELECT page_id AS doc_id, regexp_extract_all(html, '<h([1-6])[^>]*>(.*?)</h[1-6]>', 1, 'is') AS l, regexp_extract_all(html, '<h([1-6])[^>]*>(.*?)</h[1-6]>', 2, 'is') AS t FROM pages),
u AS (SELECT doc_id, unnest(l) AS l, unnest(t) AS t, generate_subscripts(l, 1) AS i FROM h)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, CAST(l AS INTEGER) AS level, {STRIP.format('t')} AS heading FROM u""")
def heading_outline(spark, sf_dir):
    return O.headings(pages(spark, sf_dir))


WORD = "the"
POSITIONS = f"""
parts AS (SELECT doc_id, text, unnest(string_split(text, '{WORD}')) AS stretch, generate_subscripts(string_split(text, '{WORD}'), 1) - 1 AS match_id, len(string_split(text, '{WORD}')) - 1 AS last FROM plain),
found AS (SELECT doc_id, text, match_id, CAST(sum(length(stretch)) OVER (PARTITION BY doc_id ORDER BY match_id) + match_id * {len(WORD)} AS INTEGER) AS pos, last FROM parts)"""


@query(f"{TEXT}, {POSITIONS} SELECT doc_id, match_id, pos FROM found WHERE match_id < last")
def word_positions(spark, sf_dir):
    return O.word_positions(texts(spark, sf_dir), WORD)


@query(f"""{TEXT}, {POSITIONS},
m AS (SELECT doc_id, match_id, pos FROM found WHERE match_id < last),
s AS (SELECT doc_id, match_id // 10 AS k, min(pos) AS start FROM m WHERE match_id % 10 = 3 GROUP BY ALL)
SELECT m.doc_id, m.match_id, m.pos, CASE WHEN m.pos - s.start <= 800 THEN 'section ' || s.k END AS section, CASE WHEN m.pos - s.start <= 800 THEN s.start END AS start
FROM m ASOF LEFT JOIN s ON m.doc_id = s.doc_id AND m.pos >= s.start""")
def section_asof_heading(spark, sf_dir):
    found = O.word_positions(texts(spark, sf_dir), WORD)
    sections = found.where("match_id % 10 = 3").select("doc_id", F.concat(F.lit("section "), F.floor(F.col("match_id") / 10).cast("string")).alias("section"), F.col("pos").alias("start"))
    return O.section_of(found, sections, 800)


@query(f"""{TEXT}, {POSITIONS},
l AS (SELECT doc_id, list({{'last': pos, 'out': [pos]}} ORDER BY pos) AS all_pos, any_value(text) AS text FROM found WHERE match_id < last GROUP BY doc_id),
k AS (SELECT doc_id, text, unnest(list_reduce(all_pos, lambda s, p: CASE WHEN p.last - s.last >= 150 THEN {{'last': p.last, 'out': list_concat(s.out, p.out)}} ELSE s END).out) AS pos FROM l)
SELECT doc_id, pos, substring(text, greatest(pos - 60, 0) + 1, pos - greatest(pos - 60, 0) + 3 + 60) AS context FROM k""")
def text_search_context(spark, sf_dir):
    return O.text_search(texts(spark, sf_dir), WORD)


KEYWORDS = ["license", "the", "password", "und", "reserved", "nothing-at-all"]


@query(f"""WITH k AS (SELECT unnest([{", ".join(f"'{k}'" for k in KEYWORDS)}]) AS keyword)
SELECT keyword, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents JOIN k ON contains(lower(text), keyword) GROUP BY keyword""")
def keyword_index(spark, sf_dir):
    return O.keyword_index(read_table(spark, sf_dir, "documents").select("doc_id", "text"), KEYWORDS)


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE role = 'assistant'),
p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS paragraph, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS position FROM t)
SELECT doc_id, position, paragraph FROM p WHERE length(paragraph) > 20 AND (contains(lower(paragraph), 'tion') OR contains(lower(paragraph), 'ung'))""")
def topic_paragraphs(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return O.topic_paragraphs(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"), ["tion", "ung"])


@query(f"""WITH {RELEASE_SQL},
s AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \n]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '(?i)\\brevenue\\b[^$]*\\$[0-9]') AND NOT regexp_matches(s, '(?i)expects')))  AS sentence FROM releases)
SELECT doc_id, sentence, CAST(regexp_extract(sentence, '\\$([0-9.]+)', 1) AS DOUBLE) * 1e6 AS value FROM s""")
def sentence_metric_extract(spark, sf_dir):
    return O.reported_metric(releases(spark, sf_dir), "revenue", "(?i)expects|outlook|guidance")


@query(f"""WITH {RELEASE_SQL},
r AS (SELECT doc_id, CAST(replace(regexp_extract(text, 'between \\$([0-9,]+) and', 1), ',', '') AS DOUBLE) * 1e3 AS low, CAST(replace(regexp_extract(text, 'and \\$([0-9,]+) thousand', 1), ',', '') AS DOUBLE) * 1e3 AS high FROM releases)
SELECT *, (low + high) / 2 AS middle FROM r""")
def guidance_ranges(spark, sf_dir):
    return O.guidance_range(releases(spark, sf_dir))


@query(f"""WITH {RELEASE_SQL},
q AS (SELECT doc_id, regexp_extract(text, 'Fiscal (20[0-9][0-9])', 1) AS y, regexp_extract(text, '(First|Second|Third|Fourth) Quarter', 1) AS n FROM releases)
SELECT doc_id, CASE WHEN y <> '' THEN 'FY' || y || CASE n WHEN 'First' THEN ' Q1' WHEN 'Second' THEN ' Q2' WHEN 'Third' THEN ' Q3' WHEN 'Fourth' THEN ' Q4' ELSE '' END END AS period FROM q""")
def fiscal_period_parse(spark, sf_dir):
    return releases(spark, sf_dir).select("doc_id", O.fiscal_period(F.col("text")).alias("period"))


@query("""SELECT page_id AS doc_id, 0 AS position, CAST(to_json([[CAST(page_id AS VARCHAR), CAST(length(html) AS VARCHAR)]]) AS VARCHAR) AS rows FROM pages
UNION ALL SELECT page_id, 1, '[["inner"]]' FROM pages""")
def html_tables(spark, sf_dir):
    row = F.concat(F.lit("<tr><th>"), F.col("doc_id").cast("string"), F.lit("</th><td>"), F.length("html").cast("string"), F.lit("<table><tr><td>inner</td></tr></table></td></tr>"))
    found = X.html_tables(pages(spark, sf_dir).select("doc_id", F.concat(F.lit("<table>"), row, F.lit("</table>"), F.col("html")).alias("html")))
    return found.withColumn("rows", F.to_json("rows"))


@query()
def section_markdown(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", O.markdown(F.col("html")).alias("markdown"))


@query("""SELECT s_suppkey AS doc_id, s_name AS owner, 0 AS position, CAST(s_suppkey * 10 AS DOUBLE) AS shares, CAST(s_suppkey % 50 AS DOUBLE) + 0.5e0 AS price, ['P', 'S', 'X'][s_suppkey % 3 + 1] AS code,
CAST(s_suppkey * 10 AS DOUBLE) * (CAST(s_suppkey % 50 AS DOUBLE) + 0.5e0) AS value, ['Purchase', 'Sale', 'Other/Unclassified'][s_suppkey % 3 + 1] AS kind FROM supplier""")
def form4_parse(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    code = F.element_at(F.array(F.lit("P"), F.lit("S"), F.lit("X")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    number = lambda c: c.cast("string")
    xml = F.concat(
        F.lit("<ownershipDocument><reportingOwner><rptOwnerName>"), F.col("s_name"), F.lit("</rptOwnerName></reportingOwner><nonDerivativeTransaction><transactionCoding><transactionCode>"), code,
        F.lit("</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"), number(F.col("s_suppkey") * 10), F.lit("</value></transactionShares><transactionPricePerShare><value>"),
        number(F.col("s_suppkey") % 50), F.lit(".5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></ownershipDocument>"),
    )
    return O.insider_transactions(s.select(F.col("s_suppkey").alias("doc_id"), xml.alias("xml")))
