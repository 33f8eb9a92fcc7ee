"""Filing documents: text of HTML, headings, sections, tables, search, reported metrics and topics."""

from __future__ import annotations

import html as html_lib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def strip_html(html: Column) -> Column:
    """The text without scripts, styles and tags, with single spaces. Entities stay; ``unescape`` resolves them."""
    text = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?s)<[^>]*>", " "), "[ \t\n\r\f\x0b]+", " "))


def unescape(text: Column) -> Column:
    """HTML entities resolved; Spark has no function for that."""

    @F.pandas_udf("string")
    def resolved(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html_lib.unescape(t))

    return resolved(text)


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, position, level and heading of every h1 to h6."""
    found = F.regexp_extract_all("html", F.lit("(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(1))
    titles = F.regexp_extract_all("html", F.lit("(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(2))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(found.alias("level"), titles.alias("heading"))).alias("position", "h"))
    return rows.select("doc_id", "position", F.col("h.level").cast("int").alias("level"), strip_html(F.col("h.heading")).alias("heading"))


def section_of(matches: DataFrame, sections: DataFrame, within: int | None = None) -> DataFrame:
    """Each match with the nearest section that starts at or before it: a backward as-of join.

    Both are laid in one order per document, and the last section seen is carried on.
    """
    both = matches.select("doc_id", "pos", "match_id", F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("start"), F.lit(1).alias("kind")).unionByName(
        sections.select("doc_id", F.col("start").alias("pos"), F.lit(None).cast("long").alias("match_id"), "section", "start", F.lit(0).alias("kind"))
    )
    before = Window.partitionBy("doc_id").orderBy("pos", "kind", "match_id", "section").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("section", F.last("section", ignorenulls=True).over(before)).withColumn("start", F.last("start", ignorenulls=True).over(before)).where("kind = 1")
    if within is not None:
        far = F.col("pos") - F.col("start") > within
        rows = rows.withColumn("section", F.when(~far, F.col("section"))).withColumn("start", F.when(~far, F.col("start")))
    return rows.select("doc_id", "match_id", "pos", "section", "start")


def word_positions(docs: DataFrame, word: str) -> DataFrame:
    """doc_id, match_id and pos (from 0) of a literal text in the column ``text``: the stretches between matches are counted up."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", rf"\Q{word}\E")).alias("match_id", "stretch"))
    upto = Window.partitionBy("doc_id").orderBy("match_id").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.sum(F.length("stretch")).over(upto) + F.col("match_id") * len(word)
    last = F.max("match_id").over(Window.partitionBy("doc_id"))
    return parts.withColumn("pos", pos.cast("int")).withColumn("last", last).where("match_id < last").select("doc_id", F.col("match_id").cast("long").alias("match_id"), "pos")


def text_search(docs: DataFrame, word: str, spacing: int = 150, context: int = 60) -> DataFrame:
    """Matches at least ``spacing`` apart (the first one wins), each with the text around it."""
    found = word_positions(docs, word)
    each = found.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("all"))
    rows = docs.join(each, "doc_id").select("doc_id", "text", F.explode(_spaced(spacing)).alias("pos"))
    start = F.greatest(F.col("pos") - context, F.lit(0))
    return rows.select("doc_id", "pos", F.substring("text", start + 1, F.col("pos") - start + len(word) + context).alias("context"))


def _spaced(spacing: int) -> Column:
    begin = F.struct(F.lit(-spacing).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        far = p - s["last"] >= spacing
        return F.struct(F.when(far, p).otherwise(s["last"]).alias("last"), F.when(far, F.concat(s["out"], F.array(p))).otherwise(s["out"]).alias("out"))

    return F.aggregate("all", begin, step, lambda s: s["out"])


def keyword_index(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """For each keyword the documents that contain it, in any case."""
    plain = F.lower("text")
    met = F.filter(F.array(*[F.when(F.contains(plain, F.lit(k)), k) for k in keywords]), lambda x: x.isNotNull())
    rows = docs.select("doc_id", F.explode(met).alias("keyword"))
    return rows.groupBy("keyword").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def topic_paragraphs(texts: DataFrame, terms: list[str], longer_than: int = 20) -> DataFrame:
    """Paragraphs over a length that contain any of the terms, in any case."""
    rows = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "paragraph"))
    met = F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower("paragraph"), t))
    return rows.where((F.length("paragraph") > longer_than) & met)


def money(number: Column, unit: Column) -> Column:
    """A number with thousand to trillion as a double."""
    scale = F.coalesce(*[F.when(F.lower(unit) == u, f) for u, f in (("thousand", 1e3), ("million", 1e6), ("billion", 1e9), ("trillion", 1e12))], F.lit(1.0))
    return F.regexp_replace(number, ",", "").cast("double") * scale


def reported_metric(texts: DataFrame, metric: str, outlook: str) -> DataFrame:
    """The first sentence with the metric's amount that does not speak of the future, and its value."""
    sentences = F.split("text", r"(?<=[.!?])\s+")
    pattern = rf"(?i)\b{metric}\b[^$]*\$([0-9][0-9,]*(?:\.[0-9]+)?) ?(thousand|million|billion|trillion)?"
    said = F.filter(sentences, lambda s: s.rlike(pattern) & ~s.rlike(outlook))
    rows = texts.select("doc_id", F.get(said, 0).alias("sentence")).where("sentence is not null")
    return rows.select("doc_id", "sentence", money(F.regexp_extract("sentence", pattern, 1), F.regexp_extract("sentence", pattern, 2)).alias("value"))


def guidance_range(texts: DataFrame) -> DataFrame:
    """Low, high and middle of ``between $a and $b unit``."""
    pattern = r"(?i)between \$([0-9][0-9,]*(?:\.[0-9]+)?) and \$([0-9][0-9,]*(?:\.[0-9]+)?) (thousand|million|billion|trillion)"
    rows = texts.where(F.col("text").rlike(pattern))
    part = [F.regexp_extract("text", pattern, i) for i in (1, 2, 3)]
    out = rows.select("doc_id", money(part[0], part[2]).alias("low"), money(part[1], part[2]).alias("high"))
    return out.withColumn("middle", (F.col("low") + F.col("high")) / 2)


def fiscal_period(text: Column) -> Column:
    """``FY2026 Q4`` from a text that names a fiscal year and a quarter; the first of each counts."""
    year = F.regexp_extract(text, r"(?i)fiscal (?:year )?(20[0-9]{2})", 1)
    quarter = F.lower(F.regexp_extract(text, r"(?i)(first|second|third|fourth) quarter", 1))
    number = F.coalesce(*[F.when(quarter == q, i) for i, q in enumerate(("first", "second", "third", "fourth"), 1)])
    return F.when((year != "") & number.isNotNull(), F.concat(F.lit("FY"), year, F.lit(" Q"), number.cast("string"))).when(year != "", F.concat(F.lit("FY"), year))


def markdown(html: Column) -> Column:
    """Headings, list items and paragraphs as Markdown lines."""
    text = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    for level in range(1, 7):
        text = F.regexp_replace(text, f"(?i)<h{level}[^>]*>", "\n" + "#" * level + " ")
    text = F.regexp_replace(text, "(?i)<li[^>]*>", "\n- ")
    text = F.regexp_replace(text, "(?i)</?(b|strong)>", "**")
    text = F.regexp_replace(text, "(?i)<br[^>]*>|</?(p|div|article|ul|ol|h[1-6]|tr|table|nav|body|head|html)[^>]*>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, "(?s)<[^>]*>", ""), "[ \t]+", " ")
    return F.trim(F.regexp_replace(text, "\n ?(\n ?)+", "\n\n"))


def concept_columns(docs: DataFrame) -> DataFrame:
    """Words and paragraphs of each page's text."""
    plain = strip_html(F.col("html"))
    return docs.select("doc_id", plain.alias("text")).withColumn("n_words", F.size(F.split("text", " ")).cast("long"))


#: Codes of insider transactions.
TRANSACTION_CODES = {"P": "Purchase", "S": "Sale", "A": "Award", "D": "Disposition", "M": "Exercise", "F": "Tax withholding", "G": "Gift"}


def insider_transactions(xml: DataFrame) -> DataFrame:
    """Shares, price, value and kind of the transactions of ownership documents (doc_id, xml)."""
    count = lambda p: F.xpath("xml", F.lit(f"//nonDerivativeTransaction/{p}/text()"))
    rows = xml.select("doc_id", F.xpath_string("xml", F.lit("//rptOwnerName")).alias("owner"), F.posexplode(F.arrays_zip(count("transactionAmounts/transactionShares/value").alias("shares"), count("transactionAmounts/transactionPricePerShare/value").alias("price"), count("transactionCoding/transactionCode").alias("code"))).alias("position", "t"))
    label = F.coalesce(*[F.when(F.col("code") == k, v) for k, v in TRANSACTION_CODES.items()], F.lit("Other/Unclassified"))
    out = rows.select("doc_id", "owner", "position", F.col("t.shares").cast("double").alias("shares"), F.col("t.price").cast("double").alias("price"), F.col("t.code").alias("code"))
    return out.withColumn("value", F.col("shares") * F.col("price")).withColumn("kind", label)
