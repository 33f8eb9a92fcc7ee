"""Near copies of documents against brute force."""

import random

import numpy as np
import pandas as pd

from corpus_pipeline import simhash_dedup
from tallyworks.llm import near_dedup
from tallyworks.llm.near_dedup import ALIKE, _bits_apart, parities, set_fingerprint, wide_bits

from .data import docs_of, messy, messy_rows, sentence


def five(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def test_near_copies_are_dropped(spark):
    rng = random.Random(11)
    passage = sentence(rng, 30)
    texts = [sentence(rng, rng.randint(6, 200)) for _ in range(40)] + [sentence(rng, 20) + " " + passage for _ in range(30)]
    for t in texts[:30]:
        for _ in range(rng.randint(1, 6)):  # chains too: a copy of a copy
            words = t.split()
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = "other"
            texts.append(" ".join(words))
            t = rng.choice([t, texts[-1]])
    texts += ["one", "One", "", "one two"]
    sets = [five(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared * 9 >= 4 * (len(sets[i]) + len(sets[j])) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    want = sorted(i for i, r in enumerate(root) if i == r)
    assert len(want) < len(texts) - 20
    got = simhash_dedup(spark, docs_of(spark, texts), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_fingerprints_of_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 100_000):
        found = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
        ones = [int((found >> b & 1).sum()) for b in range(64)]
        assert set_fingerprint(found) % 2**64 == sum(1 << b for b in range(64) if 2 * ones[b] > n)


def test_parities_never_overstate_the_difference():
    rng = np.random.default_rng(5)
    assert ALIKE == (4, 5)
    for n in (1, 30, 500, 20_000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64))
        b = np.unique(np.concatenate([a[n // 8 :], rng.integers(-(2**63), 2**63 - 1, n // 8, dtype=np.int64)]))
        apart = sum(int(x ^ y).bit_count() for x, y in zip(parities(a).view("u8"), parities(b).view("u8"), strict=True))
        assert apart <= len(np.setxor1d(a, b))
        assert not (parities(a) ^ parities(a)).any()


def test_wide_parities_fold():
    rng = np.random.default_rng(7)
    for n in (1, 200, 256, 257, 1000, 30_000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64))
        for share in (8, 3, 1):
            more = rng.integers(-(2**63), 2**63 - 1, n // share + 1, dtype=np.int64)
            b = np.unique(np.concatenate([a[len(more) // 2 :], more]))
            wide = [pd.Series([parities(s, wide_bits(len(s))).tobytes()]) for s in (a, b)]
            apart, truth = _bits_apart(*wide)[0], len(np.setxor1d(a, b))
            assert apart == _bits_apart(*wide[::-1])[0] <= truth
            assert n < 200 or apart > 0.35 * truth


def test_messy_rows(spark):
    docs = messy(spark)
    out = simhash_dedup(spark, docs, "")
    assert out.columns == docs.columns
    sets, want = {}, []
    for r in messy_rows():
        sets.setdefault(frozenset(five(r[1] or "")), []).append(r)
    for rows in sets.values():
        want.append(min(rows, key=lambda r: (r[0] is None, r[0] or 0))[:2])
    assert sorted(map(str, (tuple(r)[:2] for r in out.collect()))) == sorted(map(str, want))
    assert simhash_dedup(spark, docs.limit(0), "").collect() == []


def test_long_batches_are_taken_in_small_parts(monkeypatch):
    """The sets of shingles of a batch are not held all at once."""
    monkeypatch.setattr(near_dedup, "PART_CHARS", 100)
    batch = pd.DataFrame({"text": ["x" * 30] * 20 + [None, "", "y" * 1000, "z"]}, index=range(7, 31))
    parts = list(near_dedup.small_parts(batch))
    assert pd.concat(parts).equals(batch) and all(p["text"].str.len().fillna(0)[1:].sum() <= 100 for p in parts)
