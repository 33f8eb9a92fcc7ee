"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

from corpus_pipeline import exact_dedup, simhash_dedup
from tallyworks.llm.bpe import digest_texts, encode_texts
from tallyworks.llm.decontaminate import contaminated, drop_contaminated
from tallyworks.llm.exact_dedup import exact_digest
from tallyworks.llm.licenses import scan_licenses
from tallyworks.llm.line_dedup import drop_near_lines, line_classes, line_members
from tallyworks.llm.quality import keep_quality, rate_quality
from tallyworks.llm.secret_scan import scan_secrets
from tallyworks.llm.simhash import simhash_digest
from tallyworks.llm.token_counts import count_tokens
from tallyworks.llm.url_filter import filter_urls

from .data import messy, messy_rows

LABELS = "doc_id long, quality int, toxic int, score string, grade string"


def labels(spark):
    rows = [(i, i % 2, 0, "x", "x") for i in range(10)] + [(3, None, 1, "x", "x"), (None, 1, 0, None, None), (77, 1, 1, "x", "x")]
    return spark.createDataFrame(rows, LABELS)


def items(spark):
    rows = [(1, messy_rows()[9][1], "x"), (1, messy_rows()[9][1], "x"), (2, None, "x"), (None, "null item with a few words", "x"), (3, "", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, window string")


PER_ROW = {
    "count_tokens": lambda s, d: count_tokens(d),
    "digest_texts": lambda s, d: digest_texts(d),
    "encode_texts": lambda s, d: encode_texts(d),
    "rate_quality": lambda s, d: rate_quality(d, labels(s)),
    "exact_digest": lambda s, d: exact_digest(d),
    "simhash_digest": lambda s, d: simhash_digest(d),
    "scan_secrets": lambda s, d: scan_secrets(d),
    "scan_licenses": lambda s, d: scan_licenses(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_a_document(spark, name):
    docs = messy(spark)
    got = PER_ROW[name](spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in messy_rows())
    assert PER_ROW[name](spark, docs.limit(0)).collect() == []


def test_line_classes(spark):
    got = line_classes(messy(spark)).collect()
    assert got and all(r["n_copies"] >= 1 for r in got)
    assert line_classes(messy(spark).limit(0)).collect() == []


def test_stages_keep_the_columns(spark):
    docs = messy(spark)
    for out in (drop_contaminated(docs, items(spark)), keep_quality(docs, labels(spark)), drop_near_lines(docs)):
        assert out.columns == docs.columns
        out.collect()
    assert drop_contaminated(docs.limit(0), items(spark)).collect() == []
    assert drop_contaminated(docs, items(spark).limit(0)).count() == docs.count()
    assert keep_quality(docs, labels(spark).limit(0)).count() == docs.count()


def test_rows_go_one_by_one(spark):
    leak = messy_rows()[9][1]
    rows = [(None, "a b c", "1"), (None, "abc", "2"), (None, "another text", "3"), (4, "abc", "4"), (4, "a text of its own", "5")] + [(6, "repeated", "6")] * 50 + [(None, leak, "7"), (4, leak + " ", "8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    want = [(None, "a b c", "1"), (None, "another text", "3"), (4, "a text of its own", "5"), (6, "repeated", "6"), (4, leak + " ", "8")]
    assert sorted(map(str, map(tuple, exact_dedup(spark, docs, "").collect()))) == sorted(map(str, want))
    want = sorted(map(str, rows[:-2]))
    assert sorted(map(str, map(tuple, drop_contaminated(docs, items(spark)).collect()))) == want
    near = simhash_dedup(spark, docs, "").collect()
    assert sorted(r["row"] for r in near) == ["1", "3", "4", "5", "6", "8"]


def test_dedup_stages_on_messy_rows(spark):
    docs = messy(spark)
    for stage in (exact_dedup, simhash_dedup):
        out = stage(spark, docs, "")
        got = [r["text"] for r in out.collect()]
        bodies = ["".join((t or "").split()) for t in got]
        assert out.columns == docs.columns and "null id" in got
        assert len(set(bodies)) == len(bodies) and set(bodies) == {"".join((r[1] or "").split()) for r in messy_rows()}
        assert stage(spark, docs.limit(0), "").collect() == []


def test_contaminated(spark):
    found = contaminated(messy(spark), items(spark)).collect()
    copies = {i for i, r in enumerate(messy_rows()) if r[1] and r[1].strip() == messy_rows()[9][1]}
    assert {r["doc_id"] for r in found} == {messy_rows()[i][0] for i in copies}
    assert {r["item_id"] for r in found} == {1}


def test_no_model_keeps_everything(spark):
    docs = messy(spark)
    got = rate_quality(docs, labels(spark).where("quality = 1")).collect()
    assert len(got) == docs.count() and all(r["kept"] and r["p_top"] is None for r in got)


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, "x", "x"), (None, "http://a.com/en/1", "x", "x"), (2, "no scheme", "x", "x"), (2, "no scheme", "x", "x"), (3, "", "x", "x"), (4, "x://" + "a" * 5000, "x", "x")], "page_id long, url string, host string, rule string")
    got = filter_urls(pages, pages.select("url").limit(0)).collect()
    assert len(got) == 6
    assert {(r["page_id"], r["host"], r["verdict"]) for r in got if r["page_id"] in (1, 2, 3)} == {(1, "", "allow"), (2, "", "allow"), (3, "", "allow")}
    assert filter_urls(pages.limit(0), pages.select("url")).collect() == []


def test_line_members_are_all_lines_of_all_documents(spark):
    """Every place of a line that repeats is listed with its class, not the first one only."""
    texts = ["a long line of text\nxx\n\nxx", "a long line of texts\nxx", None, "", "alone here in its text\na long line of text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): (r["n_copies"], r["n_links"], r["class_doc_id"], r["class_line_no"]) for r in line_members(docs).collect()}
    assert got == {
        (0, 0): (2, 1, 0, 0),
        (1, 0): (1, 1, 0, 0),
        (4, 1): (2, 1, 0, 0),
        (0, 1): (3, 0, 0, 1),
        (0, 3): (3, 0, 0, 1),
        (1, 1): (3, 0, 0, 1),
        (4, 0): (1, 0, 4, 0),
    }
    rows = line_members(messy(spark))
    lines = [line for r in messy(spark).collect() for line in (r["text"] or "").split("\n") if line]
    assert rows.count() == len(lines)
