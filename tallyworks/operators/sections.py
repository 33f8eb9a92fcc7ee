"""Sections of filing pages: headings with their levels, and items that only bold type marks.

A section ends where the next one of its level or above begins, which is one window
over a page's headings for each of the seven levels. Items in bold type (``Item
7A``) are the seventh. Offsets are those of ``filing_index.cleaned``.

Entries of a table of contents are no sections: a heading or item within or around a
link into the page, or one that ends in dotted leaders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filing_index import in_headings, marks, plain, section_headings

ITEM_LEVEL = 7
ITEM = r"(?i)^\s*item\s+[0-9]+[a-z]*\b"
LEADERS = r"(\.\s*){3,}[0-9]*\s*$|&#183;|&middot;|·"


def section_spans(pages: DataFrame) -> DataFrame:
    """doc_id, level (7: an item), heading, start, end and listed (an entry of contents) of each section of the pages (doc_id, html)."""
    marked = in_headings(marks(pages))
    order = Window.partitionBy("doc_id").orderBy("at")
    into_page = F.coalesce(F.col("href").startswith("#"), F.lit(False))
    link = F.last(F.when(F.col("tag") == "a", into_page).when(F.col("tag") == "/a", False), ignorenulls=True)
    linked = marked.withColumn("linked", F.coalesce(link.over(order), F.lit(False)))
    opens = F.col("tag").rlike("^h[1-6]$")
    in_link = linked.where("inside").groupBy("doc_id", "number").agg(F.min(F.when(opens, F.col("pos"))).alias("start"), F.max("linked").alias("linked"))
    headings = section_headings(marked).join(in_link.select("doc_id", "start", "linked"), ["doc_id", "start"])
    headings = headings.select("doc_id", "level", "heading", "start", (F.col("linked") | F.col("heading").rlike(LEADERS)).alias("listed"))
    items = linked.where(F.col("bold") & ~F.coalesce("inside", F.lit(False)) & F.col("text").rlike(ITEM))
    items = items.select("doc_id", F.lit(ITEM_LEVEL).alias("level"), plain(F.col("text")).alias("heading"), F.col("pos").alias("start"), (F.col("linked") | F.col("text").rlike(LEADERS)).alias("listed"))
    page = marked.groupBy("doc_id").agg(F.max(F.coalesce("tag_end", "pos") + F.length("text")).alias("page_end"))
    later = Window.partitionBy("doc_id").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    ends_others = ~(F.col("listed") & (F.col("level") == ITEM_LEVEL))
    following = [F.when(F.col("level") == n, F.min(F.when(ends_others & (F.col("level") <= n), F.col("start"))).over(later)) for n in range(1, ITEM_LEVEL + 1)]
    ended = headings.unionByName(items).withColumn("next", F.coalesce(*following))
    return ended.join(page, "doc_id").select("doc_id", "level", "heading", "start", F.coalesce("next", "page_end").cast("int").alias("end"), "listed")


def section_bounds(pages: DataFrame, wanted: str) -> DataFrame:
    """doc_id, start, end and status of the one section that is named by a part of its heading, or whose heading is part of the name.

    Items count where no heading fits, by how they begin. Status: OK, AMBIGUOUS (more
    than one) or NOT_FOUND; the last two have no bounds.
    """
    name = wanted.strip().lower()
    heading = F.lower("heading")
    fits = (F.col("level") < ITEM_LEVEL) & (F.contains(heading, F.lit(name)) | F.contains(F.lit(name), heading))
    begins = (F.col("level") == ITEM_LEVEL) & heading.rlike(rf"^\s*\Q{name}\E\b")
    found = section_spans(pages).where(~F.col("listed") & (fits | begins)).withColumn("item", F.col("level") == ITEM_LEVEL)
    counted = found.groupBy("doc_id", "item").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.min_by("end", "start").alias("end"))
    best = counted.groupBy("doc_id").agg(F.min_by(F.struct("n", "start", "end"), "item").alias("s"))
    only = lambda c: F.when(F.col("s.n") == 1, F.col(f"s.{c}")).alias(c)
    status = F.when(F.col("s.n") == 1, "OK").when(F.col("s.n") > 1, "AMBIGUOUS").otherwise("NOT_FOUND")
    return pages.select("doc_id").join(best, "doc_id", "left").select("doc_id", only("start"), only("end"), status.alias("status"))
