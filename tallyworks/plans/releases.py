"""Queries over releases, news pages and transcripts in many shapes, made of customers, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import releases as O
from ..sources.tables import read_table
from .registry import Group

GROUP = Group()
query = GROUP.query


def _text(c):
    return c.cast("string")


def _pick(n, *texts):
    return F.element_at(F.array(*[t if isinstance(t, F.Column) else F.lit(t) for t in texts]), (n % len(texts) + 1).cast("int"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_name FROM customer)
SELECT k AS id, CASE WHEN k % 7 < 5 THEN 0 END AS position, CASE WHEN k % 7 < 5 AND k % 5 > 0 THEN c_name END AS title, CASE WHEN k % 7 < 5 THEN 'https://ir.example.com/r/' || k END AS url,
       CASE WHEN k % 7 < 5 THEN [1704067200 + 86400 * (k % 9), 1700000000 + k, 1707559200, 1707566400][k % 4 + 1] END AS published, CASE WHEN k % 7 < 5 THEN ['date', 'epoch_s', 'iso', 'rfc2822'][k % 4 + 1] END AS time_form,
       CASE WHEN k % 7 = 5 THEN 'BAD_JSON' WHEN k % 7 = 6 THEN 'NO_RECORDS' WHEN k % 5 = 0 THEN 'NO_TITLE' ELSE 'OK' END AS status FROM c""")
def feed_records(spark, sf_dir):
    k = F.col("c_custkey")
    date = _pick(k, F.concat(F.lit('"2024-01-0'), _text(k % 9 + 1), F.lit('"')), _text(k + 1_700_000_000), '"2024-02-10T12:00:00+02:00"', '"Sat, 10 Feb 2024 12:00:00 GMT"')
    title = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit('"headline": " '), "c_name", F.lit(' ", ')))
    record = F.concat(F.lit("{"), title, F.lit('"link": "/r/'), _text(k), F.lit('", "date": '), date, F.lit("}"))
    listed = F.concat(F.lit("[7, "), record, F.lit("]"))
    body = _pick(
        k, F.concat(F.lit('{"items": '), listed, F.lit("}")), F.concat(F.lit('{"items": [], "pressReleases": '), listed, F.lit("}")), F.concat(F.lit('{"data": '), listed, F.lit("}")),
        F.concat(F.lit('{"data": {"a": 1, "b": '), listed, F.lit("}}")), F.concat(F.lit('{"feed": {"items": '), listed, F.lit("}}")), F.concat(F.lit("{"), listed), '{"items": {}}',
    )
    pages = read_table(spark, sf_dir, "customer").select(k.alias("id"), F.lit("https://ir.example.com/news").alias("base"), body.alias("body"))
    return R.json_records(pages).select("id", "position", "title", "url", F.unix_seconds("published_at").alias("published"), "time_form", "status")


@query("""
WITH t AS (SELECT conv_id, turn, role, trim(text) AS content FROM conversations),
ok AS (SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, content) - 1 AS INTEGER) AS position, role AS speaker, content, 'OK' AS status FROM t WHERE conv_id % 5 > 0 AND content <> '')
SELECT * FROM ok UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, 'RATE_LIMITED_OR_UNAVAILABLE' FROM t WHERE conv_id % 5 = 0
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, NULL, 'NOT_FOUND' FROM t WHERE conv_id % 5 > 0 AND conv_id NOT IN (SELECT id FROM ok)""")
def transcript_paragraphs(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    said = F.struct("turn", "role", F.trim("text").alias("said"), F.col("role").alias("speaker"), F.col("text").alias("content"))
    rows = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(said)), lambda r: F.struct(r["speaker"].alias("speaker"), r["content"].alias("content"))).alias("transcript"))
    note = F.when(F.col("conv_id") % 5 == 0, "Limit reached")
    return R.transcript_paragraphs(rows.select(F.col("conv_id").alias("id"), F.to_json(F.struct("transcript", note.alias("Note"))).alias("body")))


def releases(spark, sf_dir):
    """Texts that name their period and guidance in several ways, one an order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    year = lambda n: _text(F.lit(n) + k % 9)
    word = _pick(k, "first", "Second", "3rd", "fourth")
    period = _pick(
        F.floor(k / 4), F.concat(F.lit("Results of the "), word, F.lit(" quarter of fiscal "), year(2020), F.lit(".")), F.concat(F.lit("Q"), _text(k % 4 + 1), F.lit(" FY"), year(2020), F.lit(" results.")),
        F.concat(F.lit("Fiscal "), year(2020), F.lit(" brought a strong "), word, F.lit(" Quarter.")), "Results of the year.",
    )
    former = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" Against the second quarter of fiscal "), year(2010).cast("string"), F.lit(".")))
    sales = _pick(k, F.concat(F.lit(" The company expects revenue of $"), _text(c), F.lit(" million to $"), _text(c + 5), F.lit(" million.")), F.concat(F.lit(" Outlook: revenue between "), _text(c), F.lit(" and "), _text(c + 5), F.lit(" thousand.")), F.concat(F.lit(" Revenue was $"), _text(c), F.lit(" million.")))
    margin = F.when(k % 5 == 0, F.concat(F.lit(" Gross margin of "), _text(k % 40 + 10), F.lit("% - "), _text(k % 40 + 12), F.lit(".5%."))).otherwise("")
    eps = F.when(k % 7 == 0, F.concat(F.lit(" Guidance for EPS is $"), _text(k % 6), F.lit(".25 to $"), _text(k % 6), F.lit(".75."))).otherwise("")
    return read_table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat(period, former, sales, margin, eps).alias("text"))


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey // 4 % 4 AS form, 2020 + o_orderkey % 9 AS y, o_orderkey % 4 + 1 AS q, ['first', 'Second', '3rd', 'fourth'][q] AS word FROM orders)
SELECT k AS doc_id, CASE WHEN form < 3 THEN 'FY' || y || ' Q' || q WHEN k % 3 > 0 AND y - 10 >= 2000 THEN 'FY' || y - 10 || ' Q2' END AS period,
       CASE WHEN form < 3 OR k % 3 > 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status,
       CASE form WHEN 0 THEN word || ' quarter of fiscal ' || y WHEN 1 THEN 'Q' || q || ' FY' || y WHEN 2 THEN 'Fiscal ' || y || ' brought a strong ' || word || ' Quarter' ELSE CASE WHEN k % 3 > 0 THEN 'second quarter of fiscal ' || y - 10 END END AS evidence FROM r""")
def release_periods(spark, sf_dir):
    return releases(spark, sf_dir).select("doc_id", O.release_period(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("""
WITH r AS (SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS c FROM orders),
m AS (
    SELECT k AS doc_id, 'revenue' AS metric, CASE k % 3 WHEN 0 THEN c * 1e6 WHEN 1 THEN c * 1e3 END AS low, CASE k % 3 WHEN 0 THEN (c + 5) * 1e6 WHEN 1 THEN (c + 5) * 1e3 END AS high, 'USD' AS unit FROM r
    UNION ALL SELECT k, 'grossMargin', CASE WHEN k % 5 = 0 THEN k % 40 + 10.0e0 END, CASE WHEN k % 5 = 0 THEN k % 40 + 12.5e0 END, 'percent' FROM r
    UNION ALL SELECT k, 'eps', CASE WHEN k % 7 = 0 THEN k % 6 + 0.25e0 END, CASE WHEN k % 7 = 0 THEN k % 6 + 0.75e0 END, 'USD/share' FROM r)
SELECT *, (low + high) / 2 AS midpoint, CASE WHEN low IS NULL THEN 'NOT_DISCLOSED' ELSE 'FOUND' END AS status FROM m""")
def guidance_forms(spark, sf_dir):
    return O.guidance(releases(spark, sf_dir)).drop("excerpt")
