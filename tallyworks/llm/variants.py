"""Spelling variants by k-d trees over letter-count vectors.

Two words one edit apart have letter counts that differ by one up, by one down,
or by one of each: at most two in all. So near words are found by range searches
in the space of letter counts, one for each pair of lengths (equal, or one more),
and what is in range is verified letter by letter.

The search runs in two steps of the same kind. A k-d tree for each length, fitted
on a bounded sample of words (``SAMPLE_WORDS``), cuts the space into cells; every
word is at home in one cell and probes those that its range touches. In each cell
a k-d tree over all words at home prunes by the boxes of its nodes. Cells that the
sample did not cut finely enough are dealt out as a grid of parts of bounded size
in which each probe meets each home, so the sample decides on speed alone.

Results by case: a null or empty text has no words; a null doc_id is written as
nothing before the colon. Rows that repeat count again. Words may be of any
length. Equal counts fall to the first word by code points. An empty table gives
no rows. Only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: One run in so many loses a letter.
SLIP = 31
#: A form has at least so many times the occurrences.
TIMES = 10
#: Words whose counts a Python worker adds up before it hands them on.
MEMORY_WORDS = 200_000

SAMPLE_WORDS = 50_000
#: Words of a cell that is not cut further, and the sample's words that a cell has at least.
CELL_WORDS, CELL_SAMPLE = 10_000, 20
#: Letters, and some for each word, of a part of a cell.
PART_LETTERS, WORD_LETTERS = 1_500_000, 50
LEAF = 32
#: What a word is in a cell: at home, asking its own cell, asking another.
HOME, INMATE, PROBE = 0, 1, 2
#: Letter counts: a to z, and the letters from U+00C0 on folded to six. Folding and the bound only bring words nearer.
FOLDED, BOUND = 6, 120
#: Bytes of arrays that are compared at a time.
BLOCK = 1 << 23

VARIANTS_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) AS h
  FROM (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL), steps
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, length(word) + 1) AS t(i)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form, form AS root FROM forms
  UNION ALL SELECT c.word, c.form, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""

RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")


def slipped_words(doc_id: int | None, text: str | None) -> Iterator[str]:
    """The words of a text, after the slips; those of fewer letters are left out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run in RUN.findall((text or "").encode().lower().decode()):
        h = zlib.crc32(run.encode(), start)
        if h % SLIP:
            yield run
        elif len(run) > LEAST_LETTERS:
            at = h % len(run)
            yield run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of all words with ``LEAST_COUNT`` occurrences or more; counts are added up before they move."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                seen.update(slipped_words(doc_id, text))
                if len(seen) > MEMORY_WORDS:
                    yield table()
        yield table()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """The bounded counts of each row's letters."""
    kind = np.where(letters < 0x80, letters - ord("a"), 26 + letters % FOLDED).astype(np.int64)
    kinds = 26 + FOLDED
    flat = kind + kinds * np.arange(len(letters))[:, None]
    return np.minimum(np.bincount(flat.ravel(), minlength=kinds * len(letters)).reshape(-1, kinds), BOUND).astype(np.int16)


def odd_letters(counts: np.ndarray) -> np.ndarray:
    """A bit for each letter whose (bounded) count is odd; the bound may hide a change, so such letters count as even."""
    odd = (counts % 2 == 1) & (counts < BOUND)
    return (odd.astype(np.uint32) << np.arange(counts.shape[1], dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def best_cut(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and count (at most: left) that part the rows most evenly."""
    middle = counts.mean(axis=0).astype(np.int16)
    best, cut = 0, None
    for at in (middle, middle - 1):
        left = (counts <= at).sum(axis=0)
        even = np.minimum(left, len(counts) - left)
        letter = int(even.argmax())
        if even[letter] > best:
            best, cut = int(even[letter]), (letter, int(at[letter]))
    return cut


class Cells:
    """A k-d tree for each length, whose leaves are the cells."""

    def __init__(self, words: list[str], scale: float):
        """``scale``: how many words each word of the sample stands for."""
        self.trees: dict[int, tuple] = {}
        self.next = 0
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, some in sorted(by_length.items()):
            self.trees[length] = self._grown(letter_counts(letters_of(some)), scale)

    def _grown(self, counts: np.ndarray, scale: float) -> tuple:
        if len(counts) * scale > CELL_WORDS and len(counts) >= 2 * CELL_SAMPLE and (cut := best_cut(counts)):
            left = counts[:, cut[0]] <= cut[1]
            if CELL_SAMPLE <= left.sum() <= len(counts) - CELL_SAMPLE:
                return (*cut, self._grown(counts[left], scale), self._grown(counts[~left], scale))
        self.next += 1
        return (self.next - 1,)

    def tree(self, length: int) -> tuple:
        return self.trees.get(length, (-length,))

    def home(self, counts: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(counts), dtype=np.int64)
        todo = [(self.tree(length), np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            if len(node) == 1:
                out[rows] = node[0]
            else:
                letter, most, left, right = node
                below = counts[rows, letter] <= most
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def touched(self, counts: np.ndarray, length: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells of ``length`` that one count more, and ``down`` less, can lead to."""
        parts: list[tuple[np.ndarray, int]] = []
        zero = np.zeros(len(counts), dtype=np.int16)
        todo = [(self.tree(length), np.arange(len(counts)), zero, zero, {})]
        while todo:
            node, rows, ups, downs, box = todo.pop()
            fits = (ups <= 1) & (downs <= down)
            rows, ups, downs = rows[fits], ups[fits], downs[fits]
            if not len(rows):
                continue
            if len(node) == 1:
                parts.append((rows, node[0]))
                continue
            letter, most, left, right = node
            low, high = box.get(letter, (0, BOUND))
            x = counts[rows, letter]
            more_down = np.maximum(x - most, 0) - np.maximum(x - high, 0)
            more_up = np.maximum(most + 1 - x, 0) - np.maximum(low - x, 0)
            todo.append((left, rows, ups, downs + more_down, box | {letter: (low, most)}))
            todo.append((right, rows, ups + more_up, downs, box | {letter: (most + 1, high)}))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r for r, _ in parts]), np.concatenate([np.full(len(r), c) for r, c in parts])


def placed_words(words: DataFrame, cells: Cells) -> DataFrame:
    """cell, word, n and part: each word at home, as a probe there, and as a probe in every other cell that it touches (of its own length: later ones)."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, some in batch.groupby(batch["word"].str.len()):
                some = some.reset_index(drop=True)
                counts = letter_counts(letters_of(some["word"].tolist()))
                own = cells.home(counts, length)
                yield some.assign(cell=own, part=HOME)
                yield some.assign(cell=own, part=INMATE)
                row, cell = cells.touched(counts, length, 1)
                later = cell > own[row]
                yield some.iloc[row[later]].assign(cell=cell[later], part=PROBE)
                row, cell = cells.touched(counts, length + 1, 0)
                yield some.iloc[row].assign(cell=cell, part=PROBE)

    return words.mapInPandas(place, "cell long, word string, n long, part int")


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letters, of equal length or one more, are exactly one edit apart."""
    width = short.shape[1]
    if width == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    ahead, behind = short != long[:, :-1], short != long[:, 1:]
    start = np.where(ahead.any(axis=1), ahead.argmax(axis=1), width)
    end = np.where(behind.any(axis=1), behind[:, ::-1].argmax(axis=1), width)
    return start + end >= width


def near_rows(homes: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home, probe) of all rows one edit apart; ``homes`` and ``probes`` are letters, probes of equal length or one less."""
    down = 1 if homes.shape[1] == probes.shape[1] else 0
    of_homes, of_probes = letter_counts(homes), letter_counts(probes)
    odd_homes, odd_probes = odd_letters(of_homes), odd_letters(of_probes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low, high = of_homes.min(axis=0), of_homes.max(axis=0)
    ups, downs = (np.maximum(x, 0).sum(axis=1, dtype=np.int16) for x in (low - of_probes, of_probes - high))
    todo = [(np.arange(len(homes)), np.arange(len(probes)), ups, downs, low, high)]
    while todo:
        at, asked, ups, downs, low, high = todo.pop()
        fits = (ups <= 1) & (downs <= down)
        asked, ups, downs = asked[fits], ups[fits], downs[fits]
        if not len(asked):
            continue
        points = of_homes[at]
        cut = best_cut(points) if len(at) > LEAF else None
        if cut:
            letter, most = cut
            left = points[:, letter] <= most
            x = of_probes[asked, letter]
            less, more = high.copy(), low.copy()
            less[letter], more[letter] = most, most + 1
            todo.append((at[left], asked, ups, downs + np.maximum(x - most, 0) - np.maximum(x - high[letter], 0), low, less))
            todo.append((at[~left], asked, ups + np.maximum(most + 1 - x, 0) - np.maximum(low[letter] - x, 0), downs, more, high))
            continue
        step = max(1, BLOCK // (LEAF * 8))
        for a in range(0, len(at), LEAF):  # words of the same letters may be more than a leaf
            for b in range(0, len(asked), step):
                h, p = at[a : a + LEAF], asked[b : b + step]
                # an edit makes at most two letters' counts odd or even
                i, j = np.nonzero(np.bitwise_count(odd_homes[h][:, None] ^ odd_probes[p][None]) <= 2)
                size = max(1, BLOCK // homes.shape[1])
                for c in range(0, len(i), size):
                    h_of, p_of = h[i[c : c + size]], p[j[c : c + size]]
                    near = one_edit(probes[p_of], homes[h_of])
                    found.append((h_of[near], p_of[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) for each two words of the table (word, n) that are one edit apart, once."""
    total = words.count()
    share = min(1.0, SAMPLE_WORDS / max(1, total))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(share * 1_000_000)).select("word").limit(2 * SAMPLE_WORDS)
    sample = [r["word"] for r in drawn.collect()]
    placed = durable(placed_words(words, Cells(sample, total / max(1, len(sample)))))
    weight, at_home = F.length("word") + WORD_LETTERS, F.col("part") == HOME

    def parts_of(some: Column) -> Column:
        return F.greatest(F.ceil(F.sum(F.when(some, weight)) / PART_LETTERS), F.lit(1)).cast("int")

    sizes = placed.groupBy("cell").agg(parts_of(at_home).alias("home_parts"), parts_of(~at_home).alias("probe_parts"))
    large = sizes.where((F.col("home_parts") > 1) | (F.col("probe_parts") > 1))
    sized = placed.join(large, "cell", "left").fillna(1, ["home_parts", "probe_parts"])
    own_part = F.pmod(F.xxhash64("word"), F.when(at_home, F.col("home_parts")).otherwise(F.col("probe_parts"))).cast("int")
    others = F.sequence(F.lit(0), F.when(at_home, F.col("probe_parts")).otherwise(F.col("home_parts")) - 1)
    dealt = sized.select("cell", "word", "n", "part", own_part.alias("own"), F.explode(others).alias("other"))
    first, second = F.when(at_home, F.col("own")).otherwise(F.col("other")), F.when(at_home, F.col("other")).otherwise(F.col("own"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": pd.Series(dtype=str), "a_n": pd.Series(dtype="int64"), "b": pd.Series(dtype=str), "b_n": pd.Series(dtype="int64")})]
        homes = rows[rows["part"] == HOME].reset_index(drop=True)
        for _, asked in rows[rows["part"] != HOME].groupby(rows["word"].str.len()):
            if len(homes):
                asked = asked.reset_index(drop=True)
                h, p = near_rows(letters_of(homes["word"].tolist()), letters_of(asked["word"].tolist()))
                b, a = homes.iloc[h].reset_index(drop=True), asked.iloc[p].reset_index(drop=True)
                pairs = pd.DataFrame({"a": a["word"], "a_n": a["n"], "b": b["word"], "b_n": b["n"]})
                out.append(pairs[(a["part"] == PROBE) | (a["word"] < b["word"])])  # words of one cell ask each other
        return pd.concat(out)

    return dealt.groupBy("cell", first.alias("home_part"), second.alias("probe_part")).applyInPandas(search, "a string, a_n long, b string, b_n long")


def chain_ends(forms: DataFrame) -> DataFrame:
    """word and root of each row (word, form): the last form that forms of forms lead to, by doubling."""
    roots = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        following = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = durable(roots.select("word", "root").join(following, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = durable(word_counts(docs))
    links = near_words(words)
    both = links.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(links.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = durable(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.minus")).alias("other_n")))
    told = F.col("other_n") >= TIMES * F.col("n")
    roots = chain_ends(joined.where(told).select("word", F.col("other").alias("form")))
    rooted = joined.join(roots, "word", "left")
    return rooted.select("word", F.when(told, F.col("other")).alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(told, F.col("other_n")).alias("form_n"))
