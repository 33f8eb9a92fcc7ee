"""Revenue of regions by the tables of filing pages.

The tables' cells are one grid (``filing_index``). For each page and region asked
the tables that name the region are candidates; within each, windows find the row
of the total, the row or rows of the region and the column, and the first
candidate that gives both numbers counts. Any number of pages and regions is
answered in one pass over the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import filing_index as X
from .documents import section_of
from .filings import cell_number

#: Labels of a total's row; names that ask for all of China; phrases for a unit, in their order, and their factors.
TOTALS = ("total", "consolidated", "total revenues", "total net revenues", "net revenues", "revenues", "total revenue")
ALL_CHINA = ("china", "greater china")
PHRASES = {"billions": ("in billions", "$ billions"), "thousands": ("in thousands", "$ thousands"), "millions": ("in millions", "$ millions")}
FACTORS = {"billions": 1e9, "thousands": 1e3, "millions": 1e6}
UNIT_BEFORE, HEADING_BEFORE = 3000, 6000


def grid_rows(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, texts and numbers (null where a cell is none) of each row."""
    ordered = F.sort_array(F.collect_list(F.struct("cell_no", "text")))
    rows = cells.groupBy("doc_id", "table_no", "row_no").agg(F.transform(ordered, lambda c: c["text"]).alias("texts"))
    return rows.withColumn("numbers", F.transform("texts", cell_number))


def _first_place(values: Column, fits) -> Column:
    """The place of the first element that fits."""
    return F.get(F.filter(F.transform(values, lambda x, i: F.when(fits(x, i), i)), lambda i: i.isNotNull()), 0)


def _role(label: Column) -> Column:
    """What a row is of China: its mainland, Hong Kong, both together, or not said."""
    without = F.contains(label, F.lit("excluding hong kong")) | F.contains(label, F.lit("exclude hong kong"))
    hong_kong = F.contains(label, F.lit("hong kong")) | F.contains(label, F.lit("hongkong"))
    of_china = F.contains(label, F.lit("china"))
    sums = F.contains(label, F.lit("total")) | F.contains(label, F.lit("consolidated"))
    return F.when(sums & ~of_china, None).when(without | F.contains(label, F.lit("mainland")), "mainland").when(hong_kong, "hong_kong").when(F.contains(label, F.lit("greater china")), "greater").when(of_china, "china")


def region_revenue(pages: DataFrame, regions: list[str], period: str | None = None) -> DataFrame:
    """Revenue of each region on each page (doc_id, html) that has a table for it.

    Columns: doc_id, region, table_no, heading, source_column, region_label, region_revenue,
    total_revenue, ratio, unit, mainland_revenue, hong_kong_revenue and reading.

    * Total: the first row with a total's label, else the last row with a number.
    * Region: the first row with the region's name in any cell. For China, mainland and Hong Kong
      are added up if both are there; ``reading`` says COMBINED, MAINLAND_ONLY or HONG_KONG_ONLY.
    * Column: the one whose header names ``period``, else the first with a number (of the region's
      row above zero; for China of the total's row behind the label).
    * Unit: named in the table or 3,000 characters before it, else millions.
    """
    marked = X.marks(pages)
    tabled = X.table_marks(marked)
    rows = grid_rows(X.table_cells(tabled))
    asked = F.array(*[F.lit(r.lower()) for r in regions])
    named = F.filter(asked, lambda r: F.exists("texts", lambda t: F.contains(F.lower(t), r)))
    candidates = rows.select("doc_id", "table_no", F.explode(named).alias("region")).distinct()
    table = Window.partitionBy("doc_id", "table_no", "region")
    texts, numbers, row_no = F.col("texts"), F.col("numbers"), F.col("row_no")
    labelled = F.exists(texts, lambda t: F.lower(F.trim(t)).isin(*TOTALS))
    names = F.exists(texts, lambda t: F.contains(F.lower(t), F.col("region")))
    told = rows.join(candidates, ["doc_id", "table_no"]).select(
        "*",
        F.col("region").isin(*ALL_CHINA).alias("all_china"),
        F.coalesce(F.min(F.when(labelled, row_no)).over(table), F.max(F.when(F.exists(numbers, lambda x: x.isNotNull()), row_no)).over(table)).alias("total_row"),
        F.min(F.when(names, row_no)).over(table).alias("first_named"),
        F.max(F.when(row_no == 0, texts)).over(table).alias("header"),
        F.count("*").over(table).alias("n_rows"),
    )
    is_total = row_no == F.col("total_row")
    single = F.when((row_no == F.col("first_named")) & ~is_total, "named")
    roles = told.where("n_rows > 1").withColumn("role", F.when(F.col("all_china"), F.when(~is_total, _role(F.lower(F.get(texts, 0))))).otherwise(single))
    of_row = F.when(F.col("all_china"), _first_place(numbers, lambda x, i: x.isNotNull() & (i > 0))).otherwise(_first_place(numbers, lambda x, i: x > 0))
    base = F.when(F.col("all_china"), is_total).otherwise(F.col("role") == "named")
    if period is not None:
        headed = _first_place(F.col("header"), lambda h, i: F.contains(h, F.lit(period)))
        of_row = F.coalesce(F.when(F.get(numbers, headed).isNotNull(), headed), of_row)
    placed = roles.withColumn("column", F.max(F.when(base, of_row)).over(table)).where("column is not null")
    read = F.struct(F.get(numbers, F.col("column")).alias("value"), F.get(texts, 0).alias("label"))
    of = lambda role: F.max_by(F.when(F.col("role") == role, read), F.when(F.col("role") == role, row_no)).alias(role)
    found = placed.groupBy("doc_id", "table_no", "region").agg(*[of(r) for r in ("named", "mainland", "hong_kong", "greater", "china")], F.max(F.when(is_total, F.get(numbers, F.col("column")))).alias("total"), F.max(F.get("header", F.col("column"))).alias("source_column"))
    mainland, hong_kong = F.col("mainland.value"), F.col("hong_kong.value")
    both = mainland.isNotNull() & hong_kong.isNotNull()
    value = F.coalesce("named.value", F.when(both, mainland + hong_kong), mainland, "greater.value", "china.value", hong_kong)
    label = F.coalesce(*[F.when(F.col(f"{r}.value").isNotNull(), F.col(f"{r}.label")) for r in ("named", "mainland", "greater", "china", "hong_kong")])
    alone = F.col("greater.value").isNull() & F.col("china.value").isNull()
    reading = F.when(both, "COMBINED").when(mainland.isNotNull(), "MAINLAND_ONLY").when(hong_kong.isNotNull() & alone, "HONG_KONG_ONLY")
    valued = found.select("doc_id", "table_no", "region", "total", "source_column", value.alias("value"), label.alias("region_label"), reading.alias("reading"), mainland.alias("mainland"), hong_kong.alias("hong_kong")).where("value is not null and total > 0")
    first = valued.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "region").orderBy("table_no"))).where("place = 1")
    frames = X.table_frames(tabled, PHRASES, UNIT_BEFORE)
    starts = frames.select("doc_id", F.col("table_no").cast("long").alias("match_id"), F.col("start").alias("pos"))
    near = section_of(starts, X.section_headings(marked).select("doc_id", F.col("heading").alias("section"), "start"), HEADING_BEFORE)
    headings = near.select("doc_id", F.col("match_id").cast("int").alias("table_no"), F.col("section").alias("heading"))
    whole = first.join(frames.select("doc_id", "table_no", "unit_scale"), ["doc_id", "table_no"]).join(headings, ["doc_id", "table_no"])
    unit = F.when(F.col("unit_scale") == "unknown", "millions").otherwise(F.col("unit_scale"))
    factor = F.coalesce(*[F.when(unit == u, f) for u, f in FACTORS.items()])
    return whole.select(
        "doc_id", "region", "table_no", "heading", "source_column", "region_label",
        (F.col("value") * factor).alias("region_revenue"), (F.col("total") * factor).alias("total_revenue"), F.round(F.col("value") / F.col("total"), 4).alias("ratio"), unit.alias("unit"),
        (F.col("mainland") * factor).alias("mainland_revenue"), (F.col("hong_kong") * factor).alias("hong_kong_revenue"), "reading",
    )
