"""Exhibits, ranked totals and allow-lists with fixed values and against plain loops."""

import math
import random
from datetime import date, datetime, timedelta

from tallyworks.operators import events
from tallyworks.operators import filing_index as X
from tallyworks.operators.allow_lists import allowed_urls, content_allowed
from tallyworks.operators.totals import with_total

INDEX = """<table class="tableFile"><tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th><th>Size</th></tr>
<tr><td>1</td><td>Annual report [Section 13]</td><td><a href="/ixviewer/ix.html?doc=/Archives/edgar/data/1/g-2025.htm?x=1">g-2025.htm</a></td><td>10-K</td><td>27.3 MB</td></tr>
<tr><td>2</td><td>Exhibit &amp; 21</td><td>  ex21.htm </td></tr><tr><td>3</td><td>lost</td></tr>
<tr><td>4</td><td></td><td><b><a class='x' HREF='a/b/c.htm#top'>view</a> <a href="z.htm">z</a></b></td><td>EX-4</td></tr></table>"""
PLAIN = "<table><tr><td>8</td><td>EX-31.1</td><td><a href='ex31.htm'>x</a></td></tr><tr><td>9</td><td>10-K</td><td><a href='/i/ix.html?doc=/A/d/g.htm'>view</a></td></tr></table>"


def test_exhibits(spark):
    listed = X.exhibits(spark.createDataFrame([(1, INDEX), (2, PLAIN), (3, None), (4, "<table></table>")], "doc_id long, html string"))
    got = {(r["doc_id"], r["position"]): tuple(r)[2:] for r in listed.collect()}
    assert got == {
        (1, 0): ("Seq", "Description", "Document", "Type", "Size", "NO_SEQUENCE"),
        (1, 1): ("1", "Annual report [Section 13]", "g-2025.htm", "10-K", "27.3 MB", "OK"),
        (1, 2): ("2", "Exhibit & 21", "ex21.htm", "", "", "OK"),
        (1, 3): ("3", "lost", "", "", "", "TOO_FEW_CELLS"),
        (1, 4): ("4", "", "c.htm", "EX-4", "", "OK"),
        (2, 0): ("8", "EX-31.1", "ex31.htm", "", "", "OK"),
        (2, 1): ("9", "10-K", "g.htm", "", "", "OK"),
    }
    assert {tuple(r) for r in X.primary_documents(listed).collect()} == {(1, "g-2025.htm"), (2, "g.htm")}


def test_ranked_totals(spark):
    rng = random.Random(14)
    day = lambda: rng.choice([None, date(2020, 1, 1) + timedelta(days=rng.randrange(120))]) if rng.random() < 0.1 else date(2020, 1, 1) + timedelta(days=rng.randrange(120))
    fact = lambda i: (i, rng.choice("ABC"), rng.choice(["Revenues", "Sales"]), rng.choice([None, *"uvwxyz"]), day(), day(), float(rng.randrange(-5, 100)))
    regional, totals = [fact(i) for i in range(200)] + [(900, "Z", "Sales", "u", date(2020, 1, 1), date(2020, 1, 1), 1.0)], [fact(i) for i in range(60)]
    schema = "{} long, ticker string, concept string, accn string, end date, filed date, value double"
    got = {r["fact_id"]: r for r in with_total(spark.createDataFrame(regional, schema.format("fact_id")), spark.createDataFrame(totals, schema.format("total_id"))).collect()}
    assert len(got) == len(regional)
    names = ("accession", "period", "near date", "any")
    for i, ticker, concept, accn, end, filed, value in regional:
        ranked = []
        for t in totals:
            if t[1:3] == (ticker, concept):
                apart = abs((filed - t[5]).days) if filed and t[5] else None
                rank = 0 if accn is not None and accn == t[3] else 1 if end is not None and end == t[4] else 2 if apart is not None and apart <= 10 else 3
                late = lambda d: (d is not None, -d.toordinal() if d else 0)
                ranked.append((rank, apart if rank == 2 else 0, late(t[4]), late(t[5]), t[0], t[6]))
        if not ranked:
            assert got[i]["matched_by"] is None and got[i]["total"] is None
            continue
        best = min(ranked)
        assert (got[i]["matched_by"], got[i]["total_id"], got[i]["total"]) == (names[best[0]], best[4], best[5])
        assert (got[i]["ratio"] is None) == (best[5] <= 0)


def test_long_list(spark):
    rules = spark.range(100_000).selectExpr("id AS rule_id", "concat('h', id % 5000, '.example.com') AS host", "concat('/', id, '/') AS prefix", "id % 2 = 0 AS subdomains")
    urls = [(0, "https://h7.example.com/7/a?q"), (1, "https://user@WWW.h7.example.com:443/5007/"), (2, "https://h7.example.com/8/"), (3, "http://h7.example.com/7/"), (4, "https://a.b.h8.example.com/8/x"), (5, "https://a.h7.example.com/7/x"), (6, "no scheme"), (7, None), (8, "https://other.org/7/"), (9, "https://h8.example.com"), (10, "https://h7.example.com/7/a?q"), (11, "https:///7/")]
    got = {r["id"]: (r["rule_id"], r["status"]) for r in allowed_urls(spark.createDataFrame(urls, "id long, url string"), rules).collect()}
    assert got == {0: (7, "ALLOWED"), 1: (5007, "ALLOWED"), 2: (None, "PATH"), 3: (None, "SCHEME"), 4: (8, "ALLOWED"), 5: (None, "HOST"), 6: (None, "MALFORMED"), 7: (None, "MALFORMED"), 8: (None, "HOST"), 9: (None, "PATH"), 10: (7, "ALLOWED"), 11: (None, "HOST")}


def test_longest_rule(spark):
    rules = [(1, "example.com", "/", True), (2, "a.example.com", "/x", True), (3, "a.example.com", "/x/y", True), (4, "www.a.example.com", "/x/y", False), (5, None, "/", True), (6, "a.example.com", None, True), (7, "b.example.com", "", None)]
    urls = [(0, "https://a.example.com/x/y/z"), (1, "https://a.example.com/xx"), (2, "https://a.example.com/q"), (3, "https://c.a.example.com/x/y"), (4, "https://b.example.com"), (5, "https://c.b.example.com/")]
    got = allowed_urls(spark.createDataFrame(urls, "id long, url string"), spark.createDataFrame(rules, "rule_id long, host string, prefix string, subdomains boolean"))
    assert {r["id"]: r["rule_id"] for r in got.collect()} == {0: 3, 1: 2, 2: 1, 3: 3, 4: 7, 5: 1}


def test_content_types(spark):
    items = spark.createDataFrame([(1, "Story"), (2, None), (3, ""), (4, "VIDEO")], "id long, content_type string")
    types = spark.createDataFrame([("STORY",), ("story",), (None,)], "content_type string")
    assert {r["id"]: r["rejected"] for r in content_allowed(items, types).collect()} == {1: None, 2: None, 3: None, 4: "CONTENT_TYPE"}


def test_official_items_that_name_nobody_confirm_in_part(spark):
    titles = ["Acme Works merger with Bolt approved", "merger with bolt approved", "ACM: merger with bolt approved", "merger with bolt approved by XACM", None]
    news = spark.createDataFrame([(i, "ACM" if i < 4 else "ZZZ", 0, t, datetime(2024, 1, 5)) for i, t in enumerate(titles)], "item_id long, ticker string, source_rank int, title string, published_at timestamp")
    claims = spark.createDataFrame([(1, "ACM", "merger with bolt approved", date(2024, 1, 1), date(2024, 1, 9))], "claim_id long, ticker string, text string, start date, end date")

    def status(items, *names):
        table = spark.createDataFrame(list(names), "ticker string, company string")
        return events.verify(claims, news.where(items), "2024-05-01", names=table).first()["status"]

    assert status("item_id = 0", ("ACM", "Acme Works")) == "CONFIRMED" and status("item_id = 0", ("ACM", None), ("ACM", "")) == "PARTIAL"
    assert status("item_id in (1, 3, 4)", ("ACM", "Acme Works")) == "PARTIAL" and status("item_id in (1, 2)", ("ACM", None)) == "CONFIRMED"
    assert status("false", ("ACM", None)) == "NOT_FOUND"
    assert events.verify(claims, news.where("item_id = 1"), "2024-05-01").first()["status"] == "CONFIRMED"


def test_claims_meet_items_by_rare_words_as_by_all_words(spark):
    rng = random.Random(12)
    words = ["common", "usual", "frequent", *[f"w{i}" for i in range(12)]]
    news = [(i, f"T{i % 2}", " ".join(rng.choices(words, k=rng.randint(0, 8)))) for i in range(150)]
    asked = [(i, f"T{i % 2}", " ".join(rng.choices([*words, "absent"], k=rng.randint(0, 9)))) for i in range(60)]
    items = spark.createDataFrame([(*n, 1, datetime(2024, 1, 5)) for n in news], "item_id long, ticker string, title string, source_rank int, published_at timestamp")
    claims = spark.createDataFrame([(*c, date(2024, 1, 1), date(2024, 1, 9)) for c in asked], "claim_id long, ticker string, text string, start date, end date")
    want = set()
    for c, ticker, text in asked:
        mine = set(text.split())
        need = len(mine) if len(mine) <= 2 else math.ceil(0.67 * len(mine))
        want |= {(c, i, len(mine & set(t.split()))) for i, k, t in news if k == ticker and mine and len(mine & set(t.split())) >= need}
    got = [(r["claim_id"], r["item_id"], r["n_shared"]) for r in events.claim_matches(claims, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_copies_of_claims_and_items_meet_as_one(spark):
    """300 copies on both sides are one pair of word sets, not 90,000 rows, and are counted by day and rank all the same."""
    items = spark.createDataFrame([(i, "T1", "steel maker lifts output target", i % 4, datetime(2024, 1, 1 + i % 20)) for i in range(300)], "item_id long, ticker string, title string, source_rank int, published_at timestamp")
    claims = items.selectExpr("item_id AS claim_id", "ticker", "title AS text", "DATE '2024-01-03' AS start", "DATE '2024-01-06' AS end")
    claims = claims.unionByName(spark.createDataFrame([(900, None, "steel maker"), (901, "T1", ""), (902, "T1", "steel maker x y")], "claim_id long, ticker string, text string").selectExpr("*", "DATE '2024-01-03' AS start", "CAST(NULL AS DATE) AS end"))
    assert events.set_matches(events.with_set(claims, "text"), events.with_set(items, "title")).count() == 1
    got = {r["claim_id"]: (r["official"], r["in_window"], r["support"], r["old"], r["status"]) for r in events.verify(claims, items, "2024-04-10").collect()}
    assert len(got) == 303 and {v for k, v in got.items() if k < 900} == {(15, 60, 300, 150, "CONFIRMED")}
    assert {got[k] for k in (900, 901, 902)} == {(0, 0, 0, 0, "NOT_FOUND")}
