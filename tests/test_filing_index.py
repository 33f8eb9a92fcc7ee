"""The filing index on pages of several shapes, with fixed values."""

import duckdb
import pytest

from tallyworks import catalog
from tallyworks.operators import filing_index as X
from tallyworks.plans import filings

PAGE = (
    "<html><!-- <h1>no</h1> --><script>var a = '<h2>no</h2>';</script><body onload=\"go('<h3>')\">"
    "<H1 class='x'>Risk <b>Factors</b>&nbsp;&amp; more</H1><p>All amounts in millions of dollars.</p>"
    "<h2>Net sales by segment</h2><p>Net sales of each reportable segment</p>"
    "<table><tr><th>Segment</th><th>2024</th><th>2023</th></tr>"
    "<tr><td>Greater China</td><td>66,952<table><tr><td>in billions</td></tr></table> (a)</td><td>72,559</td></tr>"
    "<tr><td></td><td>1</td></tr><tr><td>Americas</td><td>5 < 6</td></tr></table>"
    "<h3></h3><h3>" + "x" * 201 + "</h3></table><h4>Open <i>end</h4>tail<table><td>lone</td></tr></body>"
)


@pytest.fixture(scope="module")
def index(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "no tags at all"), (5, "<table></table><h1>a</h1>")], "doc_id long, html string")
    return {k: v.collect() for k, v in X.filing_index(pages).items()}


def test_sections(spark, index):
    page = spark.createDataFrame([(PAGE,)], "html string").select(X.cleaned("html")).first()[0]
    got = [(r["section_no"], r["level"], r["heading"]) for r in index["sections"] if r["doc_id"] == 1]
    assert sorted(got) == [(0, 1, "Risk Factors & more"), (1, 2, "Net sales by segment"), (2, 4, "Open end")]
    for r in index["sections"]:
        if r["doc_id"] == 1:
            cut = page[r["start"] : r["end"]].lower()
            assert cut.startswith(f"<h{r['level']}") and cut.endswith(f"</h{r['level']}>")
    assert {r["doc_id"] for r in index["sections"]} == {1, 5}


def test_cells(index):
    cells = {}
    for r in index["cells"]:
        cells.setdefault((r["doc_id"], r["table_no"]), {})[r["row_no"], r["cell_no"]] = r["text"]
    assert cells == {
        (1, 0): {(0, 0): "Segment", (0, 1): "2024", (0, 2): "2023", (1, 0): "Greater China", (1, 1): "66,952 (a)", (1, 2): "72,559", (2, 0): "", (2, 1): "1", (3, 0): "Americas", (3, 1): "5 < 6"},
        (1, 1): {(0, 0): "in billions"},
        (1, 2): {(0, 0): "lone"},
    }


def test_tables(index):
    got = {r["table_no"]: r for r in index["tables"]}
    assert set(got) == {0, 1, 2}
    assert (got[0]["headers"], got[0]["row_labels"]) == (["Segment", "2024", "2023"], ["Greater China", "Americas"])
    assert (got[0]["title"], got[0]["section_no"], got[0]["unit_scale"], got[0]["confidence"]) == ("Net sales of each reportable segment", 1, "billions", "HIGH")
    assert (got[1]["title"], got[1]["unit_scale"], got[1]["confidence"]) == ("Net sales by segment", "billions", "LOW")
    assert got[2]["section_no"] == 2 and got[2]["end"] > got[2]["start"] > got[0]["end"] > got[1]["end"] > got[1]["start"] > got[0]["start"]


def test_units_are_near(spark):
    far, near = "<p>in millions</p>" + "x" * 1990, "<p>in millions</p>" + "x" * 1900
    table = "<table><tr><td>a</td></tr></table>"
    late = table + "<p>in thousands</p>"
    pages = spark.createDataFrame(list(enumerate([far + table, near + table, late, "Two Billion " * 200 + table])), "doc_id long, html string")
    got = {r["doc_id"]: r["unit_scale"] for r in X.filing_index(pages)["tables"].collect()}
    assert got == {0: "unknown", 1: "millions", 2: "unknown", 3: "billions"}


def test_references(index):
    got = {(r["doc_id"], r["keyword"], r["kind"], r["number"]) for r in index["references"]}
    assert got == {(1, "risk factors", "section", 0), (1, "segment", "section", 1), (1, "china", "table", 0), (1, "greater china", "table", 0), (1, "segment", "table", 0), (1, "americas", "table", 0), (1, "segment", "table", 1)}


def test_a_year_over_the_labels_names_no_column(spark):
    """A number like a year in a table's first cell, such as a customer's key, is no period of the table."""
    shapes = ["<table><tr><td>inner 2004 thousand</td></tr></table>", "<table><tr><td>inner</td><td>2004</td></tr></table>"]
    pages = spark.createDataFrame(list(enumerate(shapes)), "doc_id long, html string")
    assert {r["doc_id"]: r["confidence"] for r in X.filing_index(pages)["tables"].collect()} == {0: "LOW", 1: "MEDIUM"}


def test_tables_are_those_of_the_sql_for_odd_customers(spark, tmp_path):
    """Customers without orders, and keys that look like years."""
    keys = [5, 6, 2004, 2005, 5000, 5001, 5002, 5003, 5004]
    customers = spark.createDataFrame([(k, f"Customer#{k:09}") for k in keys], "c_custkey long, c_name string")
    orders = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate((k, p) for k in keys[:4] for p in ("1-URGENT", "5-LOW", "5-LOW"))], "o_orderkey long, o_custkey long, o_orderpriority string")
    duck = duckdb.connect()
    for name, rows in (("customer", customers), ("orders", orders)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalog.QUERIES["filing_tables"](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({catalog.ORACLE_SQL['filing_tables']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_customers_without_orders_have_whole_tables(spark, tmp_path):
    """Their places, units and confidence are those of the page, as for all others, in the query and in its SQL."""
    customers = spark.createDataFrame([(k, f"Customer#{k:09}") for k in (1, 6)], "c_custkey long, c_name string")
    orders = spark.createDataFrame([(1, 9, "5-LOW")], "o_orderkey long, o_custkey long, o_orderpriority string")
    duck = duckdb.connect()
    for name, rows in (("customer", customers), ("orders", orders)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    page = dict(filings.pages(spark, str(tmp_path)).select("doc_id", X.cleaned("html")).collect())
    got = catalog.QUERIES["filing_tables"](spark, str(tmp_path)).select("doc_id", "table_no", "start", "end", "unit_scale", "confidence").collect()
    tables = {(r["doc_id"], r["table_no"]): page[r["doc_id"]][r["start"] : r["end"]] for r in got}
    assert set(tables) == {(1, 0), (6, 0), (6, 1)} and all(t.startswith("<table") and t.endswith("</table>") for t in tables.values())
    assert {(r["doc_id"], r["table_no"]): (r["unit_scale"], r["confidence"]) for r in got} == {(1, 0): ("millions", "MEDIUM"), (6, 0): ("thousands", "HIGH"), (6, 1): ("thousands", "LOW")}
    want = duck.execute(f'SELECT doc_id, table_no, start, "end", unit_scale, confidence FROM ({catalog.ORACLE_SQL["filing_tables"]})').fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_marks_are_dealt_out_themselves(spark):
    """Pages that were dealt out by their id before do not keep those partitions for their marks, which are many times larger."""
    pages = spark.createDataFrame([(i, "<p>a</p>") for i in range(9)], "doc_id long, html string").repartition(3, "doc_id")
    plan = X.marks(pages)._jdf.queryExecution().executedPlan().toString()
    window, cut = plan.index("Window"), plan.index("Generate")
    assert "Exchange hashpartitioning(doc_id" in plan[window:cut]
