"""A quality classifier by ordinal cumulative-link regression on graded ratings.

The labels give three grades: 0 for low quality, 1 for good but toxic, 2 for
good and clean. One weight vector over hashed text features is shared by all
grades, and ordered thresholds cut the score: P(grade >= k) is the logistic
function of score - threshold k. The expected grade and the tail probability
P(grade = 2) follow, and a document is selected by its tail probability.

The model is fitted on a bounded sample of labelled documents, at most
SAMPLE_OF_GRADE of each grade, taken by a hash of doc_id and weighted by each
grade's share of all labels. Every document is scored on its whole text.

Results by case: a null text counts as empty; an empty text has shape features
only. Labels that are null or without a document are left out. Without two
grades to learn from there is no model: the scores are null and every document
is kept. Ties and repeated rows get equal scores. Only doc_id and text are read,
so other columns can have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each grade that the model is fitted on, at most.
SAMPLE_OF_GRADE = 3000
BUCKETS = 1 << 20
#: Features in fewer documents of the sample carry no weight.
LEAST_DOCUMENTS = 8
#: So do those where no grade's share is so many standard errors from its share of the sample.
LEAST_ERRORS = 6.0
#: Words are features by their first letters too, so that forms of one stem share a weight.
START = 5
ROUNDS = 300
RIDGE = 1e-4
STEP = 0.05
#: A document is kept if P(grade = 2) is at least this.
LEAST_TAIL = 0.5
TOP_GRADE = 2
#: Words whose weights a Python worker remembers; the memory is emptied when full.
MEMORY_WORDS = 300_000

EDGES = ".,;:!?()\"'"
MARKS = regex.compile(r"[^\w\s]{2,}")


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (BUCKETS - 1)


def shape(text: str, words: list[str], distinct: int) -> list[str]:
    """Features of form: the shares of doubled marks, capitals, bars, repeats and distinct words, in eighths."""
    n = max(1, len(words))
    shares = {
        "marks": len(MARKS.findall(text)) / n,
        "capitals": sum(map(str.isupper, text.split())) / n,
        "bars": words.count("|") / n,
        "repeats": sum(map(eq, words, words[1:])) / n,
        "distinct": distinct / n,
    }
    return [f" {name} {min(8, int(share * 8 + 0.5))}" for name, share in shares.items()]


def features(text: str | None) -> tuple[set[str], list[str]]:
    """The distinct words of the whole text, without marks at their edges, their starts, and its features of form."""
    text = text or ""
    words = text.lower().split()
    distinct = {w.strip(EDGES) for w in words}
    starts = {f"{w[:START]}~" for w in distinct}
    return distinct | starts, shape(text, words, len(distinct))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, importance: np.ndarray) -> OrdinalModel:
        """Full-batch Adam on the weighted log-likelihood of the grades."""
        flat = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        used, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        told = np.zeros(len(used))
        for k in range(TOP_GRADE + 1):
            is_k = grades == k
            centred = (is_k - is_k.mean()) / max(is_k.std(), 1e-9)
            told = np.maximum(told, np.abs(np.bincount(column, centred[row], len(used))) / np.sqrt(count))
        known = (count >= LEAST_DOCUMENTS) & (told >= LEAST_ERRORS)
        keep = known[column]
        row, column = row[keep], column[keep]
        top = TOP_GRADE
        value = np.zeros(len(used) + top)
        value[-top:] = np.arange(top) / 2 - 2  # first threshold, then the gaps' logarithms
        value[-top + 1 :] = 0
        first, second = np.zeros_like(value), np.zeros_like(value)
        share = importance / importance.sum()
        for t in range(1, ROUNDS + 1):
            weights, cuts = value[:-top], cls._cuts(value[-top:])
            score = np.bincount(row, weights[column], len(rows))
            above = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -30, 30)))
            tails = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], axis=1)
            slope = tails * (1 - tails)
            at = np.arange(len(rows))
            p = np.maximum(tails[at, grades] - tails[at, grades + 1], 1e-9)
            low, high = share * slope[at, grades] / p, share * slope[at, grades + 1] / p
            to_weights = -np.bincount(column, (low - high)[row], len(used)) + RIDGE * weights
            to_cuts = np.array([low[grades == k].sum() - high[grades == k - 1].sum() for k in range(1, top + 1)])
            gaps = np.exp(value[-top + 1 :])
            to_values = np.r_[to_cuts.sum(), [gaps[k] * to_cuts[k + 1 :].sum() for k in range(top - 1)]]
            gradient = np.r_[to_weights, to_values]
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            value -= STEP * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights = np.zeros(BUCKETS, dtype=np.float32)
        weights[used[known]] = value[:-top][known]
        return cls(weights, cls._cuts(value[-top:]))

    @staticmethod
    def _cuts(values: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[values[0], np.exp(values[1:])])


class WordWeights(dict):
    """Weights of words; a word that is missing is hashed and remembered."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = weight = float(self.weights[bucket(word)])
        return weight


def graded(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    rated = labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null")
    return rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_quality(docs: DataFrame, labels: DataFrame) -> OrdinalModel | None:
    """The model from the documents and their labels; None without two grades."""
    rated = graded(labels)
    total = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    if len(total) < 2:
        return None
    first = None
    for grade in sorted(total):
        some = rated.where(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_OF_GRADE)
        first = some if first is None else first.unionByName(some)
    found = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")  # at most SAMPLE_OF_GRADE ids a grade
    sample = found.groupBy("doc_id", "grade").agg(F.max("text").alias("text"))  # rows that repeat an id are one

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                words, form = features(text)
                found.append(np.unique(np.array([bucket(f) for f in [*words, *form]], dtype=np.int32)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "grade": batch["grade"], "features": found})

    got = sample.mapInPandas(hashed, "doc_id long, grade int, features array<int>").toArrow().sort_by("doc_id")
    grades = got["grade"].to_numpy()
    if len(set(grades.tolist())) < 2:
        return None
    rows = [np.asarray(x, dtype=np.int32) for x in got["features"].to_numpy(zero_copy_only=False)]
    size = np.bincount(grades, minlength=TOP_GRADE + 1)
    importance = np.array([total[g] / size[g] for g in grades])
    return OrdinalModel.fit(rows, grades, importance)


def quality_score(text: Column, model: OrdinalModel, spark) -> Column:
    """The model's score of each whole text, as a column."""
    shared = spark.sparkContext.broadcast(model.weights)  # BUCKETS floats, whatever the input

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight = WordWeights(shared.value).__getitem__
        for texts in batches:
            out = []
            for text in texts:
                words, form = features(text)
                out.append(sum(map(weight, words)) + sum(map(weight, form)))
            yield pd.Series(out, dtype="float64")

    return scored(text)


def _above(score: Column, threshold: float) -> Column:
    return 1 / (1 + F.exp(F.lit(float(threshold)) - score))


def rate_quality(docs: DataFrame, labels: DataFrame, least_tail: float = LEAST_TAIL) -> DataFrame:
    """doc_id, expected_grade, p_top (the tail probability) and kept of each document."""
    model = fit_quality(docs, labels)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", nothing.alias("expected_grade"), nothing.alias("p_top"), F.lit(True).alias("kept"))
    scored = docs.select("doc_id", quality_score(F.col("text"), model, docs.sparkSession).alias("score"))
    tails = [_above(F.col("score"), cut) for cut in model.thresholds]
    rated = scored.select("doc_id", sum(tails[1:], tails[0]).alias("expected_grade"), tails[-1].alias("p_top"))
    return rated.withColumn("kept", F.col("p_top") >= least_tail)


def keep_quality(docs: DataFrame, labels: DataFrame, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The documents that the classifier keeps, in their own columns."""
    model = fit_quality(docs, labels)
    if model is None:
        return docs
    score = quality_score(docs["text"], model, docs.sparkSession)
    return docs.where(_above(score, model.thresholds[-1]) >= least_tail)
