"""Bottom-k sketches against sketches and sets worked out plainly."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyworks.llm import fingerprints as fp

from .data import docs_of, messy, messy_rows, sentence


def plain_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    cuts = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    out = set()
    for cut in cuts:
        h = 42
        for w in cut:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def plain_sketch(shingles):
    return sorted(shingles)[: fp.SIZE]


def alike(a, b):
    least = sorted({*a, *b})[: fp.SIZE]
    return sum(h in a and h in b for h in least) / len(least) if least else 1.0


def written(sketch):
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in sketch)


def expected(rows):
    """Rows in any order; the next document is that of the next smaller doc_id."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        a, b, c = (plain_sketch(plain_set(t)) for t in (text, edited, after))
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), alike(set(a), set(b)), alike(set(a), set(c)))
    return out


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@pytest.mark.parametrize("count", [1, 2, 150])
def test_digest(spark, count):
    rng = random.Random(count)
    texts = [sentence(rng, rng.choice([0, 1, 4, 5, 30, 400])) for _ in range(count)]
    texts[: count // 10] = ["é😀 ñ\tÀ " * 50, None, "", "one", *[sentence(rng, 9)] * 11][: count // 10]
    ids = rng.sample(range(-1000, 10**12), count)
    rows = list(zip(ids, texts, strict=True))
    got = fp.fingerprint_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == expected(rows) and len(got) == count


def test_frequent_ids(spark):
    """A doc_id of a third of all rows has ranges of its own, in the order of the texts' hashes."""
    rows = [(5 if i % 3 else i, f"text number {i}") for i in range(300)] + [(None, f"null {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tied = docs.withColumn("tie", F.xxhash64("text"))
    parts = fp.RANGES_OF_PARTITION * 4
    ranged = fp._ranges(tied, parts).groupBy("range").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
    assert max(r["n"] for r in ranged.collect()) < 80
    order = sorted((r["doc_id"] is None, -(r["doc_id"] or 0), r["tie"], r["text"]) for r in tied.collect())
    following = {a[3]: b[3] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    got = {r["text"]: r["next_text"] for r in fp.with_next(docs).collect()}
    assert got == following


def test_estimates(spark):
    rng = random.Random(3)
    long = sentence(rng, 3000)
    half = " ".join(long.split()[:1500])
    other = sentence(rng, 1500)
    rows = [(1, long, half), (2, long, half + " " + other), (3, "", ""), (4, "", long), (5, half, long)]
    pairs = spark.createDataFrame(rows, "i long, a string, b string").select("i", "a", "b", fp.sketch(F.col("a")).alias("x"), fp.sketch(F.col("b")).alias("y"))
    x, y = F.col("x"), F.col("y")
    got = {r["i"]: r for r in pairs.select("i", fp.resemblance(x, y).alias("near"), fp.containment(x, y).alias("inside"), fp.distinct_shingles(x).alias("n"), fp.merged(x, y).alias("both")).collect()}
    for i, a, b in rows:
        a, b = plain_set(a), plain_set(b)
        assert abs(got[i]["near"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.15
        assert abs(got[i]["inside"] - (len(a & b) / len(a) if a else 1)) < 0.2
        assert abs(got[i]["n"] - len(a)) <= 0.3 * len(a)
        assert got[i]["both"] == plain_sketch(a | b)


def test_merge(spark):
    rng = random.Random(4)
    texts = [sentence(rng, rng.choice([0, 3, 40, 200])) for _ in range(60)]
    docs = docs_of(spark, texts).withColumn("part", F.when(F.col("doc_id") % 3 == 0, "a").otherwise(F.when(F.col("doc_id") < 50, "b")))
    sketches = docs.select("part", fp.sketch(F.col("text")).alias("sketch"))
    got = {r["part"]: r["sketch"] for r in fp.merge_sketches(sketches, ["part"]).collect()}
    for part in ("a", "b", None):
        ids = [i for i in range(60) if ("a" if i % 3 == 0 else "b" if i < 50 else None) == part]
        assert got[part] == plain_sketch(set().union(*(plain_set(texts[i]) for i in ids)))
    nothing = docs.where("false").select("part", fp.sketch(F.col("text")).alias("sketch"))
    assert fp.merge_sketches(nothing, ["part"]).collect() == []


def test_messy_rows(spark):
    got = fp.fingerprint_digest(messy(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in messy_rows())
    by_text = {}
    for r in fp.sketch_texts(messy(spark)).collect():
        by_text.setdefault(r["doc_id"], set()).add(tuple(r["sketch"]))
    assert by_text[0] == by_text[1] == by_text[2] == {()}
    assert fp.fingerprint_digest(messy(spark).limit(0)).collect() == []
    assert fp.fingerprint_digest(messy(spark).where("doc_id is null")).count() == 2
