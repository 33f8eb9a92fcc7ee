"""Ranked search against the scores of all pairs, and bounds against exact products."""

import math
import random
import re

import numpy as np
import pytest

from tallyworks.llm import search as s

from .data import docs_of, messy, messy_rows, sentence


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def expected(docs, items):
    terms = [(i, plain_terms(t)) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    total, length = len(terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, t in terms:
            m = 100 - 50 + 50 * len(t) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in set(plain_terms(text)) & set(t))
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:50])]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_all_scores(spark, monkeypatch, small):
    rng = random.Random(11)
    if small:  # several blocks of queries, trees and floors
        monkeypatch.setattr(s, "BLOCK_ITEMS", 7)
        monkeypatch.setattr(s, "TREE_DOCS", 64)
        monkeypatch.setattr(s, "FLOOR_DOCS", 100)
    words = [f"w{k}" for k in range(300)] + ["Émile", "ÀB", "日本", "x1"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([20, 304])]) for _ in range(rng.choice([1, 8, 40, 300]))).replace(" w1", "-W1")) for i in rng.sample(range(-500, 10**10), 400)]
    docs += [(10**11 + i, docs[0][1]) for i in range(120)] + [(1, None), (2, ""), (3, " .,-")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 10, 40])))) for i in range(15)] + [(50, docs[0][1]), (51, None), (52, "nowhere to be found"), (53, "W1 w1. w1")]
    rng.shuffle(docs)
    got = s.lexical_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got], key=str) == expected(docs, items)


def test_bounds_and_pruning():
    """No product passes its ball's bound; a search opens fewer leaves than there are."""
    rng = np.random.default_rng(12)
    rows, start = [], [0]
    for i in range(2000):
        topic = i % 40
        columns = np.unique(np.r_[rng.integers(0, 30, 5), 30 + 25 * topic + rng.integers(0, 25, 12)])
        rows.append(columns)
        start.append(start[-1] + len(columns))
    columns = np.concatenate(rows)
    values = rng.integers(3 * 10**5, 10**6, len(columns))
    weights = np.r_[rng.integers(0, 1000, 30), rng.integers(3000, 9000, 1000)]
    tree = s.BallTree(np.array(start), columns, values, weights)
    dense = np.zeros((2000, 1030), dtype=object)
    dense[np.repeat(np.arange(2000), np.diff(start)), columns] = [int(v) for v in values]
    assert sorted(np.concatenate([r for r in tree.rows if r is not None]).tolist()) == list(range(2000))
    leaves = sum(r is not None for r in tree.rows)
    for topic in range(0, 40, 5):
        terms = np.r_[rng.integers(0, 30, 1), 30 + 25 * topic + rng.choice(25, 8, replace=False)]
        exact = (dense[:, terms] * weights[terms]).sum(axis=1)
        bounds = tree.bounds(tree.local(terms))
        assert all(max(exact[r]) <= b for r, b in zip(tree.rows, bounds, strict=True) if r is not None)
        least, opened = sorted(exact)[-20], 0
        seen = {}
        for rows_of, scores in tree.search(terms, int(least)):
            opened += 1
            seen |= dict(zip(rows_of.tolist(), scores.tolist(), strict=True))
        assert {r for r, x in seen.items() if x >= least} == {r for r in range(2000) if exact[r] >= least} and all(exact[r] == x for r, x in seen.items())
        assert opened < leaves / 2


def test_equal_rows():
    tree = s.BallTree(np.arange(0, 1001, 2), np.tile([3, 9], 500), np.tile([5, 7], 500), np.array([0, 0, 0, 1, 0, 0, 0, 0, 0, 1]))
    found = [x for _, scores in tree.search(np.array([3, 9, 11]), 12) for x in scores]
    assert found == [12] * 500 and list(tree.search(np.array([3]), 10**6)) == [] and list(tree.search(np.array([4]), 1)) == []


def test_messy_rows(spark):
    rng = random.Random(13)
    docs = [(r[0], r[1]) for r in messy_rows()]
    items = [(1, docs[9][1]), (1, docs[9][1]), (2, None), (None, sentence(rng, 3) + " null text"), (3, "")]
    frame = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, terms string")
    got = s.lexical_search(messy(spark), frame).collect()
    assert sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got], key=str) == expected(docs, items)
    assert s.lexical_search(messy(spark).limit(0), frame).collect() == []
    nothing = s.lexical_search(docs_of(spark, ["a"]), frame.limit(0))
    assert nothing.collect() == [] and nothing.columns == ["item_id", "rank", "doc_id", "score"]
