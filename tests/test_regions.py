"""Revenue of regions: fixed values of several page shapes."""

import pytest

from tallyworks.operators.regions import region_revenue


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"


PAGES = {
    "note": "<h3>Note 20 – Geographic Information</h3><p>by geography (in millions):</p>" + table(("Geography", "2025", "2024"), ("United States", "$6,720", "$6,500"), ("China", "$2,840", "$2,600"), ("<b>Total</b>", "$15,630", "$14,800")),
    "revenues": "<h4>Geographic Information</h4>" + table(("Region", "FY2025"), ("Americas", "7,100"), ("China", "3,200"), ("EMEA", "2,100"), ("Revenues", "13,400")),
    "billions": "<p>(in billions):</p><h2>Revenue by Region</h2>" + table(("Area", "2025"), ("China", "$2.84"), ("United States", "$6.72"), ("Total", "$15.58")),
    "no words": "<h5>Segment Revenue Table</h5>" + table(("Segment", "Revenue"), ("North America", "8,000"), ("China", "1,600"), ("Total", "12,000")),
    "none": "<h3>Geographic Information</h3>" + table(("Region", "Revenue"), ("Americas", "10,000"), ("Total", "15,000")) + "<p>China revenues were significant.</p>",
    "nested": "<h3>Note 20</h3>" + table((table(("Country", "Revenue ($M)"), ("United States", "6,720"), ("China", "2,840"), ("Total", "15,630")),)),
    "negative": table(("Region", "Revenue"), ("CHINA", "2,840"), ("Adjustments", "(100)"), ("Total", "15,630")),
    "last row": table(("Region", "Revenue"), ("China", "10"), ("Europe", "30"), ("Sum", "40"), ("Notes", "n/a")),
    "parts": table(("Region", "2024"), ("Mainland China", "30"), ("Hong Kong", "10"), ("Total China", "40"), ("Total", "100")),
    "own total": table(("Total China", "5"), ("China", "5")),
    "empty": "",
    "null": None,
    "far unit": "<p>in billions</p>" + "x" * 3000 + table(("China", "1"), ("Total", "2")),
    "suffix": table(("China", "1.5B"), ("Total", "3B")),
}


@pytest.fixture(scope="module")
def got(spark):
    names = list(PAGES)
    pages = spark.createDataFrame([(i, PAGES[n]) for i, n in enumerate(names)], "doc_id long, html string")
    rows = region_revenue(pages, ["China", "Americas"]).collect()
    return {(names[r["doc_id"]], r["region"]): r for r in rows}


def test_ratios(got):
    ratio = {name: r["ratio"] for (name, region), r in got.items() if region == "china"}
    assert ratio == {"note": 0.1817, "revenues": 0.2388, "billions": 0.1823, "no words": 0.1333, "nested": 0.1817, "negative": 0.1817, "last row": 0.25, "parts": 0.4, "own total": 1.0, "far unit": 0.5, "suffix": 0.5}
    assert {name for name, region in got if region == "americas"} == {"revenues", "none"}


def test_values(got):
    note = got["note", "china"]
    assert (note["region_revenue"], note["total_revenue"], note["unit"], note["heading"], note["source_column"], note["region_label"]) == (2.84e9, 15.63e9, "millions", "Note 20 – Geographic Information", "2025", "China")
    assert (got["billions", "china"]["region_revenue"], got["billions", "china"]["unit"]) == (2.84e9, "billions")
    assert got["far unit", "china"]["unit"] == "millions" and got["suffix", "china"]["region_revenue"] == 1.5e15
    parts = got["parts", "china"]
    assert (parts["mainland_revenue"], parts["hong_kong_revenue"], parts["reading"]) == (30e6, 10e6, "COMBINED")


def test_period(spark):
    page = spark.createDataFrame([(1, PAGES["note"])], "doc_id long, html string")
    row = region_revenue(page, ["China", "United States"], "2024").collect()
    assert {(r["region"], r["region_revenue"], r["source_column"]) for r in row} == {("china", 2.6e9, "2024"), ("united states", 6.5e9, "2024")}
    assert {r["source_column"] for r in region_revenue(page, ["China"], "1999").collect()} == {"2025"}
