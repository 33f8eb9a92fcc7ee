"""Exact, near and line duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyworks.llm.bloom import ask_bloom, blocked_bloom, keep_rows, row_keys
from tallyworks.llm.components import connected_components
from tallyworks.llm.exact_dedup import exact_copies, exact_digest
from tallyworks.llm.line_dedup import banded_distance, drop_near_lines, letter_counts, line_classes, split_lines, within
from tallyworks.llm.simhash import GolayAnchors, fingerprint, home_anchors, near_duplicates, replicas, simhash_digest

from .data import docs_of, sentence


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_exact(spark):
    rng = random.Random(1)
    base = [sentence(rng, 30) for _ in range(20)]
    texts = [rng.choice(base) for _ in range(100)]
    texts = [t.replace(" ", rng.choice([" ", "  ", "\n", "\t\x0b"])) for t in texts] + [None, "", " ", base[0] + "x", "shared prefix " * 20 + "a", "shared prefix " * 20 + "b"]
    got = {r["doc_id"]: r for r in exact_digest(docs_of(spark, texts)).collect()}
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for t in texts]
    for i, n in enumerate(norm):
        group = [j for j, m in enumerate(norm) if m == n]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert tuple(got[i][c] for c in ("keep_id", "group_size", "kept", "text_sha256")) == (keep, len(group), keep == i, hashlib.sha256(n.encode()).hexdigest())
    assert {r["doc_id"] for r in exact_copies(docs_of(spark, texts)).collect()} == {i for i in got if not got[i]["kept"]}


def test_golay_code():
    code = GolayAnchors(2)
    words = np.arange(1 << 23, dtype=np.int64)[:: 7919]
    homes = code.home(words)
    assert np.bitwise_count((words ^ homes).astype("u8")).max() <= 3  # a perfect code of radius 3
    assert (code.syndrome(homes) == 0).all()
    index, near = code.near(words[:50], 2)
    every = np.unique(code.home(np.arange(1 << 23, dtype=np.int64)))
    assert len(every) == 4096
    for i in range(50):
        assert set(near[index == i]) == set(every[np.bitwise_count((every ^ words[i]).astype("u8")) <= 5])


def test_every_pair_of_two_bits_meets():
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    y = x.copy()
    for _ in range(2):
        y ^= np.left_shift(np.int64(1), rng.integers(0, 64, 300))
    code = GolayAnchors(2)
    index, anchor = replicas(y, code)
    met = set(zip(index.tolist(), anchor.tolist(), strict=True))
    assert all((i, a) in met for i, a in enumerate(home_anchors(x, code).tolist()))


def test_simhash(spark):
    rng = random.Random(2)
    texts = [sentence(rng, 300) for _ in range(30)]
    for t in texts[:15]:
        for _ in range(4):
            words = t.split()
            words[rng.randrange(300)] = "other"
            texts.append(" ".join(words).upper())
    texts += [None, "", "one", "One", "one two", texts[0]]
    fps = [plain_fingerprint(t) for t in texts]
    assert fps == [fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = components(range(len(fps)), links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_digest(docs_of(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in want}
    assert len(set(want.values())) < len(texts) - 10
    assert {r["doc_id"] for r in near_duplicates(docs_of(spark, texts)).collect()} == {i for i in want if want[i] != i}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components(nodes, [x for x in links if x[0] != x[1]])


def test_banded_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        rows.append((a, "".join(b)))
    pairs = spark.createDataFrame([r for r in rows if r[1]], "a string, b string")
    for k in (1, 2, 3):
        both = pairs.select(banded_distance(F.col("a"), F.col("b"), k).alias("got"), F.levenshtein("a", "b").alias("want")).collect()
        assert all(r["got"] == r["want"] if r["want"] <= k else r["got"] > k for r in both)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + row[1:], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def linked(a, b):
    return abs(len(a) - len(b)) <= 2 and edits(a, b) <= min(2, max(len(a), len(b)) // 4)


def check_lines(spark, texts, least_links):
    first, copies = {}, {}
    for d, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if line:
                first.setdefault(line, (d, n))
                copies[line] = copies.get(line, 0) + 1
    links = [(first[a], first[b]) for a in first for b in first if a < b and linked(a, b)]
    want = components(first.values(), links)
    got = {(r["doc_id"], r["line_no"]): r for r in line_classes(docs_of(spark, texts)).collect()}
    assert set(got) == set(first.values()) and len(links) >= least_links
    for line, at in first.items():
        r = got[at]
        assert (r["class_doc_id"], r["class_line_no"]) == want[at]
        assert r["n_links"] == sum(at in x for x in links) and r["n_copies"] == copies[line]
    return first, want


def test_line_classes(spark):
    rng = random.Random(6)
    lines = [sentence(rng, 4) for _ in range(40)]
    for t in lines[:25]:
        for _ in range(3):
            i = rng.randrange(len(t))
            lines.append(t[:i] + rng.choice(["", "x", "yz"]) + t[i + rng.randint(0, 2) :])
    lines += ["short", "shirt", "short", "a", "b", "ab", "abc", "abcd", "Copyright 2023 A. Ltd", "Copyright 2024 A. Ltd"]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)] + [None, ""]
    first, want = check_lines(spark, texts, 20)
    kept = {r["doc_id"]: r["text"] for r in drop_near_lines(docs_of(spark, texts)).collect()}
    for d, t in enumerate(texts):
        if t:
            assert kept[d] == "\n".join(x for n, x in enumerate(t.split("\n")) if want[first[x]] == (d, n))


def test_short_lines(spark):
    rng = random.Random(16)
    lines = ["".join(rng.choice("abé😀") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    check_lines(spark, ["\n".join(lines[i : i + 20]) for i in range(0, 400, 20)], 80)


def test_many_lines_of_one_segment(spark):
    rng = random.Random(17)
    numbers = rng.sample(range(10**9), 3000)
    lines = [f"the same start of every line, then {x:09d} and the same end of every line" for x in numbers]
    got = line_classes(docs_of(spark, ["\n".join(lines[i : i + 50]) for i in range(0, 3000, 50)])).collect()
    digits = np.array([[int(c) for c in f"{x:09d}"] for x in numbers], dtype=np.int8)
    pairs = {(i, j) for i in range(3000) for j in np.flatnonzero((digits != digits[i]).sum(axis=1) <= 2).tolist() if i < j}
    shorter = {}  # of equal length, so the other two edits are a deletion and an insertion
    for i, x in enumerate(numbers):
        for at in range(9):
            shorter.setdefault(f"{x:09d}"[:at] + f"{x:09d}"[at + 1 :], set()).add(i)
    pairs |= {(i, j) for same in shorter.values() for i in same for j in same if i < j}
    n_links = np.bincount(np.array(sorted(pairs)).ravel(), minlength=3000)
    assert pairs and sorted(r["n_links"] for r in got) == sorted(n_links.tolist())


def test_rows_of_one_doc_id(spark):
    rows = [(5, "a line that stands here only\nthe very same line in both"), (5, "the very same line in both\nanother one of its own"), (None, "a line without any id"), (None, "a lime without any id")] + [(7, "seven times the same text")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in drop_near_lines(docs).collect()]
    assert sorted(x for _, t in kept for x in t.split("\n") if x and "seven" not in x) in (
        sorted(["a line that stands here only", "the very same line in both", "another one of its own", x]) for x in ("a line without any id", "a lime without any id")
    )
    assert [t for i, t in kept if i == 7] == ["seven times the same text"] * 2 and len(kept) == 6


def test_bloom(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("k"))
    asked = ask_bloom(spark.range(5000).withColumn("k", F.xxhash64("id")), "k", blocked_bloom(keys, "k", 64), "maybe", 64)
    got = {r["id"]: r["maybe"] for r in asked.collect()}
    assert all(got[i] for i in range(500)) and sum(got.values()) < 2500
    docs = docs_of(spark, ["a"] * 50)
    left = keep_rows(docs, docs.where("doc_id % 3 = 0").select(*row_keys(), F.lit(False).alias("stays")))
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(50) if i % 3]


def test_within_two_edits(spark):
    rng = random.Random(8)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    pairs = [("", ""), ("", "ab"), ("", "abc"), ("aa", "a"), ("ab", "ba"), ("abab", "baba")]
    for _ in range(300):
        a = "".join(rng.choice("aet é") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "t", " ", "é"])
        pairs.append((a, "".join(b)))
    bits = F.bit_count(letter_counts(F.col("a")).bitwiseXOR(letter_counts(F.col("b"))))
    near = [within(F.col("a"), F.col("b"), k).alias(f"near{k}") for k in (1, 2, 3)]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", bits.alias("bits"), *near).collect():
        d = distance(r["a"], r["b"])
        assert [r["near1"], r["near2"], r["near3"]] == [d <= 1, d <= 2, d <= 3], (r, d)
        assert r["bits"] <= 2 * d


def test_letters_are_counted_in_whole_lines(spark):
    code = (0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000)
    lines = ["", "e", "eta oin", "wwwwwwwww", "é" * 20 + "shrdlu", "the cat sat on the mat " * 200]
    rows = docs_of(spark, lines).select("doc_id", letter_counts(F.col("text")).alias("bits")).collect()
    for r in rows:
        want = "".join(f"{code[lines[r['doc_id']].count(c) % 8]:04b}" for c in "etaoinshrdlucmfw")
        assert f"{r['bits'] % (1 << 64):064b}" == want


def test_a_text_is_split_once(spark, tmp_path):
    docs_of(spark, ["a\n\nb", "", None, "\n", "c"]).write.parquet(f"{tmp_path}/docs")
    lines = split_lines(spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted((r["doc_id"], r["line_no"], r["line"]) for r in lines.collect()) == [(0, 0, "a"), (0, 2, "b"), (4, 0, "c")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # Spark's own check that there are lines split a text twice more


def test_edits_behind_a_very_long_start(spark):
    pairs = spark.range(1).selectExpr("repeat('ab', 1100000) || 'xcy' AS a", "repeat('ab', 1100000) || 'wcv' AS b")
    assert pairs.select(within(F.col("a"), F.col("b"), 2).alias("near")).first()["near"]
