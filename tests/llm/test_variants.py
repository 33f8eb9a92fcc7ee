"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyworks.llm import variants as v

from .data import docs_of, messy, messy_rows


def plain_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    n = plain_words(rows)
    near = defaultdict(list)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def variants_of(rng, word):
    letters = "abcdefghijklmnopqrstuvwxyzéÀß÷"
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


def fixture(rng, n):
    stems = ["".join(rng.choice("aeinrstlé") for _ in range(rng.randint(7, 11))) for _ in range(n)]
    words = []
    for s in stems:
        words += [s] * rng.choice([2, 3, 40, 400]) + [variants_of(rng, s) for _ in range(8)] * 2
        words += [variants_of(rng, variants_of(rng, s))] * rng.choice([2, 20])
        words.append("".join(rng.sample(s, len(s))))
    words += ["chainword"] * 900 + ["chainwort"] * 60 + ["chainworts"] * 3
    words += ["abcdefg" * 30] * 2 + ["abcdefg" * 30 + "x"] * 40 + ["listens", "silents", "enlists", "tinsels"] * 3
    rng.shuffle(words)
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words]
    return [(i, ", ".join(words[k : k + 50]) + " 12x") for i, k in enumerate(range(0, len(words), 50))]


@pytest.mark.parametrize("fine", [False, True])
def test_against_all_pairs(spark, monkeypatch, fine):
    rng = random.Random(8)
    rows = fixture(rng, 30)
    if fine:  # many cells, many parts
        monkeypatch.setattr(v, "CELL_WORDS", 20)
        monkeypatch.setattr(v, "CELL_SAMPLE", 4)
        monkeypatch.setattr(v, "PART_LETTERS", 700)
    got = v.spelling_variants(docs_of(spark, [t for _, t in rows])).collect()
    want = expected(rows)
    assert len(want) > 150 and any(r[1] not in (w, r[0]) for w, r in want.items())
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)


def test_cells_lose_nothing():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("aeinrst") for _ in range(rng.randint(7, 9))) for _ in range(3000)})
    cells = v.Cells(words[::3], 200)
    assert cells.next > 20
    home = {}
    for length in (7, 8, 9, 10):
        some = [w for w in words if len(w) == length] or ["a" * length]
        counts = v.letter_counts(v.letters_of(some))
        home |= dict(zip(some, cells.home(counts, length).tolist(), strict=True))
    for w in rng.sample(words, 200):
        counts = v.letter_counts(v.letters_of([w]))
        reached = {*v.Cells.touched(cells, counts, len(w), 1)[1].tolist(), *cells.touched(counts, len(w) + 1, 0)[1].tolist()}
        assert all(home[x] in reached for x in words if len(x) >= len(w) and one_apart(w, x))


def test_near_rows():
    rng = random.Random(10)
    words = sorted({"".join(rng.choice("abc") for _ in range(8)) for _ in range(500)})
    short = sorted({w[:3] + w[4:] for w in words[::5]} | {"aaaaaaa"})
    for probes in (words, short):
        h, p = v.near_rows(v.letters_of(words), v.letters_of(probes))
        got = set(zip(h.tolist(), p.tolist(), strict=True))
        assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(probes) if one_apart(a, b)} and len(got) == len(h)
    assert np.array_equal(v.letter_counts(v.letters_of(["a" * 500]))[0, :2], [v.BOUND, 0])


def test_messy_rows(spark):
    got = v.spelling_variants(messy(spark)).collect()
    rows = [(r[0], r[1]) for r in messy_rows()]
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == expected(rows)
    assert v.spelling_variants(messy(spark).limit(0)).collect() == []
