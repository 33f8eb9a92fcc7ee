"""An index of filing pages: headings, tables and cells with their places, units, titles and keyword references.

A page is cut at its tags into marks, one row a tag with the text behind it. All
else is windows over a page's marks in order: nesting is a running depth, and the
table that a mark belongs to is the last one opened at its depth. Nothing is
parsed in Python, and a page's length is bounded by its own marks only.

Offsets count from 0 in the page as ``cleaned`` gives it: without comments,
scripts, styles and event handlers. Null pages have no marks. Headings without an
end or a text, or of more than 200 characters, are left out; tables without cells
too. An end tag without a start is passed over; a table without an end ends with
the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .documents import section_of

HEADING_CHARS, LABEL_CHARS = 200, 100
#: Characters before a table in which its unit, and its title, may stand.
UNIT_BEFORE, TITLE_BEFORE = 2000, 500
#: Words that name a scale, the larger ones first; keywords of the index; characters of a title.
SCALES = {"billions": ("billion",), "millions": ("million",), "thousands": ("thousand",)}
KEYWORDS = ("china", "greater china", "prc", "geographic", "segment", "revenue", "customers", "long-lived assets", "risk factors", "americas", "europe", "japan", "asia", "rest of asia")
TITLE_OVER, TITLE_UNDER = 10, 200
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def cleaned(html: Column) -> Column:
    """The page without comments, scripts, styles and event handlers."""
    out = html
    for _ in range(2):  # what is left of a script within a script goes too
        out = F.regexp_replace(out, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\s*\1[^>]*>", "")
    return F.regexp_replace(out, r"""(?i)\s+on\w+=("[^"]*"|'[^']*'|[^\s>]+)""", " ")


def plain(text: Column) -> Column:
    for entity, letter in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f\x0b ]+", " "))


def marks(pages: DataFrame) -> DataFrame:
    """doc_id, at (from 0), pos, tag (lower case, with a slash if it ends one), tag_end, href (of a link), bold (whether the tag begins bold type) and text of each mark of the pages (doc_id, html)."""
    # marks are many times their pages: partitions that suit the pages are too large to sort marks in without spilling.
    # An id that is made anew does not count as dealt out, so the windows deal out the marks themselves.
    own = pages.select(F.explode(F.array("doc_id")).alias("doc_id"), "html")
    pieces = own.select("doc_id", F.posexplode(F.split(cleaned(F.col("html")), "<")).alias("at", "body"))
    tag = F.when(F.col("at") > 0, F.lower(F.regexp_extract("body", r"(?s)^(/?[A-Za-z][A-Za-z0-9]*)\b[^>]*>", 1))).otherwise("")
    text = F.when(F.col("tag") != "", F.regexp_replace("body", "(?s)^[^>]*>", "")).when(F.col("at") == 0, F.col("body")).otherwise(F.concat(F.lit("<"), "body"))
    target = F.regexp_extract("body", r"""(?is)^a\b[^>]*?\bhref\s*=\s*["']([^"'>]+)["']""", 1)
    bold = F.col("tag").isin("b", "strong") | ((F.col("tag") == "span") & F.col("body").rlike(r"(?is)^[^>]*font-weight:\s*bold"))
    size = F.length("body") + F.when(F.col("at") > 0, 1).otherwise(0)
    told = pieces.withColumn("tag", tag).withColumn("text", text).select("doc_id", "at", size.alias("size"), "tag", F.when((F.col("tag") == "a") & (target != ""), target).alias("href"), bold.alias("bold"), "text")
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = told.withColumn("pos", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int"))
    tag_end = F.when(F.col("tag") != "", F.col("pos") + F.col("size") - F.length("text")).cast("int")
    return placed.select("doc_id", "at", "pos", "tag", tag_end.alias("tag_end"), "href", "bold", "text")


def _joined() -> Column:
    """The texts of a group in order, as one plain text."""
    return plain(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), " "))


def in_headings(marked: DataFrame) -> DataFrame:
    """The marks with number (of the heading begun last) and inside (whether it is open)."""
    order = Window.partitionBy("doc_id").orderBy("at")
    opens, closes = F.col("tag").rlike("^h[1-6]$"), F.col("tag").rlike("^/h[1-6]$")
    return marked.withColumn("number", F.sum(opens.cast("int")).over(order)).withColumn("inside", F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(order))


def section_headings(marked: DataFrame) -> DataFrame:
    """doc_id, section_no (from 0), section_id, level, heading, start and end of the headings h1 to h6."""
    opens, closes = F.col("tag").rlike("^h[1-6]$"), F.col("tag").rlike("^/h[1-6]$")
    own = in_headings(marked).where(F.col("inside") | (closes & (F.col("number") > 0)))
    level = F.min(F.when(opens, F.substring("tag", 2, 1).cast("int")))
    named = own.groupBy("doc_id", "number").agg(level.alias("level"), F.min(F.when(opens, F.col("pos"))).alias("start"), F.min(F.when(closes, F.col("tag_end"))).alias("end"), _joined_where(F.col("inside")).alias("heading"))
    kept = named.where(F.col("end").isNotNull() & (F.length("heading") > 0) & (F.length("heading") <= HEADING_CHARS))
    section_no = (F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1).alias("section_no")
    return kept.select("doc_id", section_no, F.left(F.regexp_replace(F.lower("heading"), "[^a-z0-9]+", "_"), F.lit(60)).alias("section_id"), "level", "heading", "start", "end")


def _joined_where(inside: Column) -> Column:
    some = F.collect_list(F.when(inside, F.struct("at", "text")))
    return plain(F.array_join(F.transform(F.sort_array(some), lambda s: s["text"]), " "))


def table_marks(marked: DataFrame) -> DataFrame:
    """The marks with depth (open tables, this mark's tag counted) and table_no (the innermost one's number in its page, from 0)."""
    order = Window.partitionBy("doc_id").orderBy("at")
    opens = F.col("tag") == "table"
    raw = marked.withColumn("raw", F.sum(F.when(opens, 1).when(F.col("tag") == "/table", -1).otherwise(0)).over(order)).withColumn("number", F.sum(opens.cast("int")).over(order) - 1)
    # an end without a start lowers the floor that depth is counted from
    deep = raw.withColumn("depth", F.col("raw") - F.least(F.min("raw").over(order), F.lit(0)))
    last_opened = F.last(F.when(opens, F.col("number")), ignorenulls=True).over(Window.partitionBy("doc_id", "depth").orderBy("at"))
    return deep.withColumn("table_no", F.when(F.col("depth") > 0, last_opened).cast("int")).drop("raw", "number")


def _in_cells(tabled: DataFrame) -> DataFrame:
    """The marks inside cells, with row and cell (running numbers in their table)."""
    order = Window.partitionBy("doc_id", "table_no").orderBy("at")
    cell = F.col("tag").isin("td", "th")
    inside = F.last(F.when(cell, True).when(F.col("tag").isin("/td", "/th", "tr", "/tr", "table"), False), ignorenulls=True).over(order)
    read = tabled.where("table_no is not null").withColumn("inside", inside).withColumn("row", F.sum((F.col("tag") == "tr").cast("int")).over(order)).withColumn("cell", F.sum(cell.cast("int")).over(order))
    return read.where("inside")


def table_cells(tabled: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, cell_no (all from 0) and text of each cell; a table within a cell is its own."""
    texts = _in_cells(tabled).groupBy("doc_id", "table_no", "row", "cell").agg(_joined().alias("text"))
    in_table = Window.partitionBy("doc_id", "table_no")
    row_no = (F.dense_rank().over(in_table.orderBy("row")) - 1).alias("row_no")
    cell_no = (F.row_number().over(Window.partitionBy("doc_id", "table_no", "row").orderBy("cell")) - 1).alias("cell_no")
    return texts.select("doc_id", "table_no", row_no, cell_no, "text")


def html_tables(pages: DataFrame) -> DataFrame:
    """doc_id, position and rows (arrays of cell texts) of each table with cells of the pages (doc_id, html)."""
    cells = table_cells(table_marks(marks(pages)))
    in_order = lambda place, what: F.transform(F.sort_array(F.collect_list(F.struct(place, what))), lambda s: s[what])
    rows = cells.groupBy("doc_id", "table_no", "row_no").agg(in_order("cell_no", "text").alias("row"))
    return rows.groupBy("doc_id", F.col("table_no").alias("position")).agg(in_order("row_no", "row").alias("rows"))


def table_frames(tabled: DataFrame, scales: dict[str, tuple[str, ...]] = SCALES, unit_before: int = UNIT_BEFORE) -> DataFrame:
    """doc_id, table_no, start, end, unit_scale and title (null if none stands near enough) of each table.

    The unit is the first of ``scales`` one of whose phrases stands in the table or ``unit_before`` characters before it.
    """
    order = Window.partitionBy("doc_id").orderBy("at")
    told = F.lower("text")

    def last_place(phrases: tuple[str, ...]) -> Column:
        """Where one of the phrases stood last, up to a mark."""
        places = [F.lit(None).cast("int")]
        for phrase in phrases:
            back = F.instr(F.reverse(told), phrase[::-1])
            places.append(F.when(back > 0, F.coalesce("tag_end", "pos") + F.length("text") - back - len(phrase) + 1))
        return F.last(F.greatest(F.lit(None).cast("int"), *places), ignorenulls=True).over(order)

    shown = F.when(plain(F.col("text")) != "", F.struct(plain(F.col("text")).alias("text"), F.coalesce("tag_end", "pos").alias("pos")))
    before = F.last(shown, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    read = tabled.select("*", *[last_place(phrases).alias(w) for w, phrases in scales.items()], before.alias("before"))
    opens, closes = F.col("tag") == "table", F.col("tag") == "/table"
    # an end belongs to the table last opened one deeper than what follows it
    level = F.when(opens, F.col("depth")).when(closes, F.col("depth") + 1)
    number = F.sum(opens.cast("int")).over(order) - 1
    bounds = read.withColumn("level", level).withColumn("number", number).where("level is not null")
    closed = F.last(F.when(opens, F.col("number")), ignorenulls=True).over(Window.partitionBy("doc_id", "level").orderBy("at"))
    ends = bounds.withColumn("table_no", closed.cast("int")).where(closes & F.col("table_no").isNotNull())
    page = tabled.groupBy("doc_id").agg(F.max(F.coalesce("tag_end", "pos") + F.length("text")).alias("page_end"))
    # up to its end a table's unit may have been named last at any of its marks
    own = read.where("table_no is not null").select("doc_id", "table_no", "at", "pos", opens.alias("opens"), F.lit(None).cast("int").alias("end"), *scales, "before")
    last = ends.select("doc_id", "table_no", "at", "pos", F.lit(False).alias("opens"), F.col("tag_end").alias("end"), *scales, "before")
    rows = own.unionByName(last).groupBy("doc_id", "table_no").agg(F.min(F.when(F.col("opens"), F.col("pos"))).alias("start"), F.min("end").alias("end"), *[F.max(w).alias(w) for w in scales], F.min_by("before", "at").alias("before"))
    scale = F.coalesce(*[F.when(F.col(w) >= F.col("start") - unit_before, w) for w in scales], F.lit("unknown"))
    size = F.length("before.text")
    title = F.when((F.col("before.pos") >= F.col("start") - TITLE_BEFORE) & (size > TITLE_OVER) & (size < TITLE_UNDER), F.col("before.text"))
    return rows.join(page, "doc_id").select("doc_id", "table_no", "start", F.coalesce("end", "page_end").cast("int").alias("end"), scale.alias("unit_scale"), title.alias("title"))


def table_index(tabled: DataFrame, sections: DataFrame) -> DataFrame:
    """One row a table with cells: its frame, section_no, title (else the section's heading), headers, row_labels and confidence."""
    cells, frames = table_cells(tabled), table_frames(tabled)
    first = F.col("row_no") == 0
    label = (F.col("row_no") > 0) & (F.col("cell_no") == 0) & (F.length("text") > 0) & (F.length("text") < LABEL_CHARS)
    texts = lambda some, place: F.transform(F.sort_array(F.collect_list(F.when(some, F.struct(place, "text")))), lambda s: s["text"])
    read = cells.groupBy("doc_id", "table_no").agg(texts(first, "cell_no").alias("headers"), texts(label, "row_no").alias("row_labels"))
    starts = frames.select("doc_id", F.col("table_no").cast("long").alias("match_id"), F.col("start").alias("pos"))
    near = section_of(starts, sections.select("doc_id", F.col("section_no").cast("string").alias("section"), "start"))
    of_section = near.select("doc_id", F.col("match_id").cast("int").alias("table_no"), F.col("section").cast("int").alias("section_no"))
    # the first header is over the labels, so a year there names no column
    years = F.exists(F.filter("headers", lambda h, i: i > 0), lambda h: h.rlike(r"\b20\d\d\b"))
    labels, scaled = F.size("row_labels") > 0, F.col("unit_scale") != "unknown"
    confidence = F.when(years & labels & scaled, "HIGH").when(years | labels, "MEDIUM").otherwise("LOW")
    whole = frames.join(read, ["doc_id", "table_no"]).join(of_section, ["doc_id", "table_no"])
    titled = whole.join(sections.select("doc_id", "section_no", "heading"), ["doc_id", "section_no"], "left").withColumn("title", F.coalesce("title", "heading", F.lit("")))
    return titled.select("doc_id", "table_no", "section_no", "start", "end", "title", "headers", "row_labels", "unit_scale", confidence.alias("confidence"))


def keyword_references(sections: DataFrame, tables: DataFrame, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """The inverted index: doc_id, keyword, kind (section or table) and number of each heading or table that holds the keyword, in any case."""
    heading = sections.select("doc_id", F.lit("section").alias("kind"), F.col("section_no").alias("number"), F.lower("heading").alias("told"))
    words = F.lower(F.concat_ws(" ", "row_labels", "headers", "title"))
    both = heading.unionByName(tables.select("doc_id", F.lit("table").alias("kind"), F.col("table_no").alias("number"), words.alias("told")))
    held = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col("told"), k))
    return both.select("doc_id", F.explode(held).alias("keyword"), "kind", "number")


def filing_index(pages: DataFrame, keywords: tuple[str, ...] = KEYWORDS) -> dict[str, DataFrame]:
    """The index of pages (doc_id, html) as the tables sections, cells, tables and references."""
    marked = marks(pages)
    sections, tabled = section_headings(marked), table_marks(marked)
    tables = table_index(tabled, sections)
    return {"sections": sections, "cells": table_cells(tabled), "tables": tables, "references": keyword_references(sections, tables, keywords)}


def exhibits(pages: DataFrame) -> DataFrame:
    """The documents that filing index pages (doc_id, html) list: a row of a table each, in the order of the page.

    Columns: doc_id, position (from 0), sequence, description, document (the file that
    the third cell links to, else its text), type, size and status: OK,
    TOO_FEW_CELLS (under three) or NO_SEQUENCE (the first cell starts with no
    digit, as in a header).
    """
    marked = _in_cells(table_marks(marks(pages)))
    cells = marked.groupBy("doc_id", "table_no", "row", "cell").agg(_joined().alias("text"), F.min_by("href", F.when(F.col("href").isNotNull(), F.col("at"))).alias("href"))
    ordered = F.sort_array(F.collect_list(F.struct("cell", "text", "href")))
    rows = cells.groupBy("doc_id", "table_no", "row").agg(ordered.alias("cells"))
    text = lambda i: F.get("cells", i)["text"]
    file = F.regexp_replace(F.regexp_replace(plain(F.get("cells", 2)["href"]), "^.*/", ""), "[?#].*$", "")
    status = F.when(F.size("cells") < 3, "TOO_FEW_CELLS").when(~text(0).rlike("^[0-9]"), "NO_SEQUENCE").otherwise("OK")
    position = (F.row_number().over(Window.partitionBy("doc_id").orderBy("table_no", "row")) - 1).alias("position")
    blank = F.lit("")
    return rows.select("doc_id", position, text(0).alias("sequence"), F.coalesce(text(1), blank).alias("description"), F.coalesce(file, text(2), blank).alias("document"), F.coalesce(text(3), blank).alias("type"), F.coalesce(text(4), blank).alias("size"), status.alias("status"))


def primary_documents(listed: DataFrame) -> DataFrame:
    """doc_id and document of the first exhibit with sequence 1 or an annual report's type or description, that is not the index itself."""
    annual = F.upper("type").startswith("10-K") | F.upper("description").startswith("10-K")
    own = (F.col("status") == "OK") & ((F.col("sequence") == "1") | annual) & (F.col("document") != "") & ~F.lower("document").rlike(r"-index\.html?$")
    return listed.where(own).groupBy("doc_id").agg(F.min_by("document", "position").alias("document"))
