"""Ranked lexical search: exact inner products by sparse ball trees.

A document is a sparse vector over the terms of the queries, and a query one of
its terms' weights. Each task packs its documents in blocks, and each block in a tree of
balls (centroid and radius). A query's product with any document of a ball is at
most its product with the centroid plus its own length times the radius, where
only terms that stand in the ball count; the bound is rounded upwards by more than
doubles can err. Balls are opened best first until none can reach the score of
the last document that is listed; documents of an opened leaf are scored in whole
numbers. The listed documents of all tasks meet in one ranking a query.

A bounded sample (``FLOOR_DOCS``) is searched first; the scores that it reaches
bound the search of all documents from below and leave no result out. Queries are
taken in blocks of bounded size (``BLOCK_ITEMS``, ``BLOCK_TERMS``), each in one
pass over the texts.

Results by case: a null or empty text has no terms, and neither has one of
separators only; such a document is not counted and such an item lists nothing.
Texts of any length are read whole. Rows that repeat are documents, or items, of
their own, so ranks of a repeated item_id repeat. Equal scores are listed by
ascending doc_id, null last. Empty tables give no rows. Only item_id, doc_id and
text are read, so other columns can have any name.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import durable

LISTED = 50
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 50_000
FLOOR_DOCS = 20_000
#: Documents, and entries of their vectors, of one tree, and documents of a leaf.
TREE_DOCS, TREE_ENTRIES, LEAF = 8_192, 2_000_000, 32
#: Bounds are raised by so much of themselves and by one: doubles err by less than a thousandth of it.
ROUNDING = 1e-9

#: Bytes of a text as bytes of terms: A to Z in lower case, separators as spaces.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(0x100)).lower()

SEARCH_SQL = r"""
WITH told AS (
  SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS term
  FROM documents
), counted AS (SELECT row, doc_id, term, count(*) AS tf FROM told GROUP BY ALL),
lengths AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY row),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, corpus GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item, item_id, term FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS term
    FROM benchmark)
), scored AS (
  SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (row), corpus GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return (text or "").encode().translate(LETTERS).split()


class Queries:
    """A block of items: their distinct terms as numbers."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        self.terms = [np.array(sorted(self.number.setdefault(t, len(self.number)) for t in terms), dtype=np.int64) for _, terms in items]


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """The items in blocks of at most ``BLOCK_ITEMS`` items and, but for a last one's own, ``BLOCK_TERMS`` terms."""

    @F.pandas_udf("array<binary>")
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(terms_of(t))))

    block, size = [], 0
    for row in items.select("item_id", distinct("text").alias("terms")).toLocalIterator():
        block.append((row["item_id"], [bytes(t) for t in row["terms"]]))
        size += len(row["terms"])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield Queries(block)
            block, size = [], 0
    if block:
        yield Queries(block)


def document_vectors(docs: DataFrame, queries: Queries) -> DataFrame:
    """doc_id, n (its terms), terms and tfs (those of the queries) of every document that has a term."""
    number = queries.number

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, terms, tfs, rows = [], [0], [], [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                if own := terms_of(text):
                    counts = Counter(map(number.get, own))
                    counts.pop(None, None)
                    terms += counts.keys()
                    tfs += counts.values()
                    ends.append(len(terms))
                    n.append(len(own))
                    rows.append(row)
            at = pa.array(ends, pa.int32())
            columns = [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(vectors, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def term_weights(vectors: DataFrame, queries: Queries, docs: int) -> np.ndarray:
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").count()
    df = np.zeros(len(queries.number), dtype=np.int64)
    for row in held.collect():  # as many as the block has terms
        df[row["term"]] = row["count"]
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


class BallTree:
    """A tree over sparse rows: row i has the entries from ``start[i]`` on; ``values``, and the ``weights`` that queries give to columns, are whole numbers of int64."""

    def __init__(self, start: np.ndarray, columns: np.ndarray, values: np.ndarray, weights: np.ndarray):
        self.known, local = np.unique(columns, return_inverse=True)
        self.start, self.columns, self.values = start, local, values
        self.weights = weights[self.known]
        self.x = values.astype(np.float64)
        self.norms = np.add.reduceat(self.x * self.x, start[:-1])
        self.radius: list[float] = []
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        centres: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(np.arange(len(start) - 1), -1)]
        while todo:
            rows, parent = todo.pop()
            node = len(self.radius)
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            entries, of = self._entries(rows)
            centre = np.bincount(self.columns[entries], weights=self.x[entries], minlength=len(self.known)) / len(rows)
            away = self._distances(rows, entries, of, centre)
            support = np.flatnonzero(centre)
            centres.append((support, centre[support]))
            # a squared distance is a difference of larger squares: what those can err is added
            self.radius.append(math.sqrt(max(0.0, away.max()) + ROUNDING * (self.norms[rows].max() + centre @ centre)))
            self.children.append(None)
            self.rows.append(rows if len(rows) <= LEAF else None)
            if len(rows) > LEAF:
                right = self._parted(rows, entries, of, away)
                todo += [(rows[~right], node), (rows[right], node)]
        count = np.array([len(c) for c, _ in centres])
        node, column, value = np.repeat(np.arange(len(count)), count), np.concatenate([c for c, _ in centres]), np.concatenate([v for _, v in centres])
        order = np.argsort(column, kind="stable")
        self.node, self.value = node[order], value[order]
        self.first = np.searchsorted(column[order], np.arange(len(self.known) + 1))
        self.radii = np.array(self.radius)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of some rows and the place of each one's row among them."""
        n = self.start[rows + 1] - self.start[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return np.arange(len(of)) + np.repeat(self.start[rows] - (np.cumsum(n) - n), n), of

    def _distances(self, rows: np.ndarray, entries: np.ndarray, of: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances of the rows from a point."""
        product = np.bincount(of, weights=self.x[entries] * point[self.columns[entries]], minlength=len(rows))
        return self.norms[rows] - 2 * product + point @ point

    def _parted(self, rows: np.ndarray, entries: np.ndarray, of: np.ndarray, away: np.ndarray) -> np.ndarray:
        """Which rows go right: those nearer to the second of two far rows, or half of them if none parts them."""

        def point(row: int) -> np.ndarray:
            out = np.zeros(len(self.known))
            at = slice(self.start[row], self.start[row + 1])
            out[self.columns[at]] = self.x[at]
            return out

        from_one = self._distances(rows, entries, of, point(rows[away.argmax()]))
        right = self._distances(rows, entries, of, point(rows[from_one.argmax()])) < from_one
        if not LEAF // 4 <= right.sum() <= len(rows) - LEAF // 4:
            right = np.arange(len(rows)) >= len(rows) // 2
        return right

    def local(self, terms: np.ndarray) -> np.ndarray:
        """The terms that stand in this tree, as its own columns."""
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        return at[self.known[at] == terms]

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """At each node more than the product of its rows with the terms' weights."""
        at = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in terms])
        weight = np.repeat(self.weights[terms], self.first[terms + 1] - self.first[terms]).astype(np.float64)
        product = np.bincount(self.node[at], weights=self.value[at] * weight, minlength=len(self.radii))
        length = np.sqrt(np.bincount(self.node[at], weights=weight * weight, minlength=len(self.radii)))
        return (product + length * self.radii) * (1 + ROUNDING) + 1

    def search(self, terms: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of opened leaves, best first; each step may be sent a higher ``least``."""
        terms = self.local(terms)
        if not len(terms):
            return
        bounds = self.bounds(terms)
        asked = np.zeros(len(self.known), dtype=np.int64)
        asked[terms] = self.weights[terms]
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            rows = self.rows[node]
            entries, of = self._entries(rows)
            scores = np.zeros(len(rows), dtype=np.int64)
            np.add.at(scores, of, self.values[entries] * asked[self.columns[entries]])
            least = (yield rows, scores) or least


def document_trees(batches: Iterator[pa.RecordBatch], weights: np.ndarray, docs: int, terms: int) -> Iterator[tuple[list, BallTree]]:
    """The doc_ids of each block of vectors and its tree."""
    ids, sizes, columns, values, entries = [], [], [], [], 0

    def tree() -> tuple[list, BallTree]:
        return ids, BallTree(np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(columns), np.concatenate(values), weights)

    for whole in batches:
        for at in range(0, whole.num_rows, TREE_DOCS // 4):
            batch = whole.slice(at, TREE_DOCS // 4)
            n = np.array([100 - 50 + 50 * x * docs // terms for x in batch["n"].to_pylist()], dtype=np.int64)
            size = np.diff(batch["terms"].offsets.to_numpy())
            term, tf = batch["terms"].flatten().to_numpy(), batch["tfs"].flatten().to_numpy()
            ids += batch["doc_id"].to_pylist()
            sizes.append(size)
            columns.append(term)
            values.append(1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(n, size)))
            entries += len(term)
            if len(ids) >= TREE_DOCS or entries >= TREE_ENTRIES:
                yield tree()
                ids, sizes, columns, values, entries = [], [], [], [], 0
    if ids:
        yield tree()


def best_of_tasks(vectors: DataFrame, queries: Queries, weights: np.ndarray, docs: int, terms: int, floors: dict[int, int], item_kind: DataType) -> DataFrame:
    """item (its place), item_id, doc_id and score: each task's ``LISTED`` best documents of each item, as far as they reach its floor."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries.ids]
        for doc_ids, tree in document_trees(batches, weights, docs, terms):
            for item, asked in enumerate(queries.terms):
                listed, floor = best[item], floors.get(item, 1)
                least = lambda: max(floor, listed[-1][0] if len(listed) == LISTED else 1)  # noqa: B023, E731
                found = tree.search(asked, least())
                step = next(found, None)
                while step is not None:
                    rows, scores = step
                    some = scores >= least()
                    if some.any():
                        listed += [(s, doc_ids[r]) for s, r in zip(scores[some].tolist(), rows[some].tolist(), strict=True)]
                        listed.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                        del listed[LISTED:]
                    try:
                        step = found.send(least())
                    except StopIteration:
                        step = None
        rows = [(item, queries.ids[item], doc, score) for item, listed in enumerate(best) for score, doc in listed]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "item_id", "doc_id", "score"])

    doc_kind = vectors.schema["doc_id"].dataType
    kinds = [pa.int32(), to_arrow_type(item_kind), to_arrow_type(doc_kind), pa.int64()]
    schema = f"item int, item_id {item_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score long"
    return vectors.where(F.size("terms") > 0).mapInArrow(search, schema)


def ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LISTED)


def search_block(docs: DataFrame, queries: Queries, kind: DataType) -> DataFrame:
    vectors = durable(document_vectors(docs, queries))
    seen = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    total, terms = seen["docs"], seen["terms"] or 1
    weights = term_weights(vectors, queries, total)
    floors: dict[int, int] = {}
    if total > FLOOR_DOCS:
        share = F.lit(int(1_000_000 * FLOOR_DOCS / total) + 1)
        some = vectors.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1_000_000)) < share)
        reached = ranked(best_of_tasks(some, queries, weights, total, terms, {}, kind)).where(F.col("rank") == LISTED)
        floors = {r["item"]: r["score"] for r in reached.select("item", "score").collect()}  # one an item of the block
    return ranked(best_of_tasks(vectors, queries, weights, total, terms, floors, kind)).select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score: the best ``LISTED`` documents of each item."""
    kind = items.schema["item_id"].dataType
    blocks = [search_block(docs, queries, kind) for queries in query_blocks(items)]
    if not blocks:
        nothing = docs.select("doc_id").where(F.lit(False))
        return nothing.select(F.lit(None).cast(kind).alias("item_id"), F.lit(1).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, blocks)
