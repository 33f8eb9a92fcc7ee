"""Bounds of sections, fixed values."""

from tallyworks.operators import filing_index as X
from tallyworks.operators.sections import section_bounds, section_spans

CONTENTS = "<h2><a href='#r'>Risk</a></h2><a href=\"#r\"><h3>Risk</h3></a><h2>Risk .... 7</h2>"
ONE = "<h2 id='r'>Risk <a href='x.htm'>factors</a></h2><p>x</p><h3>y</h3><b>Item 9</b>"
ITEMS = "<p><a href='#a'><b>Item 1A. Risks</b></a></p><p><b>Item 1A. Risks</b> are</p><p><strong>Items</strong><b>Item</b></p><p><span style='color:red; font-weight:bold'>Item 7</span> text"


def found(spark, pages, wanted):
    frame = spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string")
    clean = {r["doc_id"]: r["c"] for r in frame.select("doc_id", X.cleaned("html").alias("c")).collect()}
    rows = {r["doc_id"]: r for r in section_bounds(frame, wanted).collect()}
    return [(rows[i]["status"], clean[i][rows[i]["start"] : rows[i]["end"]] if rows[i]["start"] is not None else None) for i in range(len(pages))]


def test_headings(spark):
    pages = [CONTENTS + ONE + "<h2>Next</h2>", ONE + ONE, "<script><h2>Risk</h2></script>" + ONE, CONTENTS, "", None, "<h1>r</h1>" + ONE.replace("Risk", "Dis")]
    assert found(spark, pages, " Risk ") == [("OK", ONE), ("AMBIGUOUS", None), ("OK", ONE), ("NOT_FOUND", None), ("NOT_FOUND", None), ("NOT_FOUND", None), ("OK", "<h1>r</h1>" + ONE.replace("Risk", "Dis"))]


def test_items(spark):
    first = "<b>Item 1A. Risks</b> are</p><p><strong>Items</strong><b>Item</b></p><p>"
    assert found(spark, [ITEMS, ITEMS + "<h4>End</h4>", "<h1>Of item 1a</h1>" + ITEMS], "item 1A") == [("OK", first), ("OK", first), ("OK", "<h1>Of item 1a</h1>" + ITEMS)]
    assert found(spark, [ITEMS, ITEMS + "<h4>End</h4>", ITEMS + ITEMS], "Item 7") == [("OK", "<span style='color:red; font-weight:bold'>Item 7</span> text"), ("OK", "<span style='color:red; font-weight:bold'>Item 7</span> text"), ("AMBIGUOUS", None)]
    assert found(spark, [ITEMS], "Item 1") == [("NOT_FOUND", None)]


def test_levels(spark):
    page = "<h1>a</h1><h3>b</h3><h2>c</h2><h3>d</h3><h1>e</h1>"
    rows = section_spans(spark.createDataFrame([(1, page)], "doc_id long, html string")).collect()
    assert {r["heading"]: page[r["start"] : r["end"]] for r in rows} == {"a": page[: page.index("<h1>e")], "b": "<h3>b</h3>", "c": "<h2>c</h2><h3>d</h3>", "d": "<h3>d</h3>", "e": "<h1>e</h1>"}
