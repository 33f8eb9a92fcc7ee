"""Near-duplicate documents by SimHash anchors and an exact join of five-word shingles.

Two texts are near copies if the Jaccard similarity of their sets of shingles
is 0.8 or more. In an order of all shingles that both share, such texts have a
shingle in common among the first n - ceil(0.8 n) + 1 of their n. Any order
will do; here shingles that are frequent in a sample of the documents come
last, so that a passage of many documents makes no pairs.

Candidates are the pairs whose SimHash fingerprints, made of the shingles, the anchors of
``simhash`` link at two bits, and, as near copies of similarity 0.8 can be ten
bits apart, the texts at a shingle with the one that has it earliest. What that
links is one component and needs no more comparing, so a large group of near
copies costs a few pairs a text. Then texts of different components that still
share a shingle are compared, so that no component misses a link. Sets are
compared whole; a shingle stands as 64 bits. Before that, pairs are dropped by
the parities of their sets: each shingle flips one of 512 bits, so two sets
differ in at least as many shingles as their parities differ in bits. No near
copies are lost by it, and pairs that only share a passage make no rows. As long
sets would fill 512 bits, the pairs left are asked by parities of two bits a shingle
or more, of which the larger is folded to the smaller; texts are read after that.

Results by case: a text of five words or fewer is one shingle, so is one without
words. Of a component the smallest doc_id stays, null last, and of rows that
repeat both doc_id and text one. All columns of the documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .bloom import ask_bloom, blocked_bloom, keep_rows, row_keys
from .common import durable
from .components import connected_components
from .simhash import BLOCK, MAX_BITS, fingerprint_links

WIDTH = 5
#: The least similarity, as a fraction of whole numbers.
ALIKE = (4, 5)
SEED = 42
#: One document of so many is read for the frequent shingles; the most frequent ones, at most so many, are broadcast.
SAMPLE_OF = 16
FREQUENT = 100_000
#: 64-bit parts of the parities of any set, and the most bits that a long set's have.
PARTS = 8
MOST_BITS = 1 << 24
#: Characters of text whose sets of shingles a task holds at once.
PART_CHARS = 1_000_000
#: Odd numbers, one for each word's place in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype="u8")


def shingles(text: str | None) -> np.ndarray:
    """The different shingles of a text as sorted signed longs."""
    words = (text or "").encode().lower().split()
    if len(words) <= WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype="u8").view("i8")
    digest, n = xxhash.xxh64_intdigest, len(words) - WIDTH + 1
    hashes = np.array([digest(w, SEED) for w in words], dtype="u8")
    mixed = np.zeros(n, dtype="u8")
    for k in range(WIDTH):
        mixed += hashes[k : k + n] * PLACES[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= PLACES[0]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view("i8"))


def set_fingerprint(found: np.ndarray) -> int:
    """A bit is set if it is in over half of the shingles."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), BLOCK):
        ones += np.unpackbits(found[i : i + BLOCK].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def parities(found: np.ndarray, bits: int = 64 * PARTS) -> np.ndarray:
    """Of each of the bits, whether an odd number of the shingles fall on it."""
    on = np.bincount((found.view("u8") >> np.uint64(40)).astype("i8") % bits, minlength=bits) & 1
    return np.packbits(on.astype(bool), bitorder="little").view("<i8")


def wide_bits(n: int) -> int:
    """How many bits the wide parities of n shingles have: a power of two, so that larger ones fold to smaller ones."""
    return min(max(64 * PARTS, 1 << (2 * n - 1).bit_length()), MOST_BITS)


def _bits_apart(left: pd.Series, right: pd.Series) -> pd.Series:
    """In how many bits two wide parities differ, the larger folded to the smaller."""

    def apart(a: bytes, b: bytes) -> int:
        x, y = np.frombuffer(a, "u8"), np.frombuffer(b, "u8")
        parts = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(w.reshape(-1, parts), axis=0) for w in (x, y))
        return int(np.unpackbits((x ^ y).view("u1")).sum())

    return pd.Series([apart(a, b) for a, b in zip(left, right, strict=True)], dtype="i8")


bits_apart = F.pandas_udf(_bits_apart, LongType())


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which near copies share one: rare ones first, then by value."""
    at = np.minimum(np.searchsorted(frequent, found), max(len(frequent) - 1, 0))
    often = np.where(frequent[at] == found, counts[at], 0) if len(frequent) else np.zeros(len(found))
    n, (up, down) = len(found), ALIKE
    return found[np.lexsort((found, often))][: n + (-n * up // down) + 1]


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of the sample have, sorted, and in how many they are."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"shingle": shingles(text)})

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE_OF)) == 0).select("text")
    counted = some.mapInPandas(spread, "shingle long").groupBy("shingle").count().where("count > 2")
    rows = counted.orderBy(F.desc("count"), "shingle").limit(FREQUENT).collect()  # FREQUENT rows
    table = np.array(sorted((r["shingle"], r["count"]) for r in rows), dtype="i8").reshape(-1, 2)
    return table[:, 0].copy(), table[:, 1].copy()


def small_parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of PART_CHARS characters of text or a row more, so that the sets held at once are few whatever the texts' lengths."""
    part = batch["text"].str.len().fillna(0).cumsum() // PART_CHARS
    for _, rows in batch.groupby(part.to_numpy(), sort=False):
        yield rows


def shingle_rows(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, node (of the set of shingles), fp (its fingerprint), odd and wide (its parities), n (its size) and head (its prefix) of each row."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for batch in small_parts(whole):
                sets = [shingles(t) for t in batch["text"]]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype="u8").view("i8")
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"],
                        "k1": batch["k1"],
                        "k2": batch["k2"],
                        "node": nodes,
                        "fp": [set_fingerprint(s) for s in sets],
                        "odd": [parities(s) for s in sets],
                        "wide": [parities(s, wide_bits(len(s))).tobytes() for s in sets],
                        "n": [len(s) for s in sets],
                        "head": [prefix(s, *frequent.value) for s in sets],
                    }
                )

    asked = docs.select(F.col("doc_id").cast("string").alias("doc_id"), *row_keys(), "text")
    kind = docs.schema["doc_id"].dataType
    return asked.mapInPandas(read, "doc_id string, k1 long, k2 long, node long, fp long, odd array<long>, wide binary, n int, head array<long>").withColumn("doc_id", F.col("doc_id").cast(kind))


def node_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and shingles of the ``nodes`` (node, k1), each read from the row k1."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for batch in small_parts(whole):
                yield pd.DataFrame({"node": batch["node"], "shingles": [shingles(t) for t in batch["text"]]})

    keyed = docs.select(row_keys()[0], "text")
    some = ask_bloom(keyed, "k1", blocked_bloom(nodes, "k1"), "maybe").where("maybe").drop("maybe")
    one = some.groupBy("k1").agg(F.min("text").alias("text"))
    return one.join(nodes, "k1").select("node", "text").mapInPandas(read, "node long, shingles array<long>")


def alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose sets of shingles are near copies."""
    up, down = ALIKE
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = durable(node_sets(docs, nodes.select("node", F.col("first.k1").alias("k1")).join(wanted, "node")))
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(shared * (up + down) >= up * (F.size("a_set") + F.size("b_set"))).select("a", "b")


def _could_be(a: str, b: str) -> str:
    """False only if two texts whose first common shingle is at these places are no near copies."""
    up, down = ALIKE
    return f"{up + down} * least({a}.n - {a}.at, {b}.n - {b}.at) >= {up} * ({a}.n + {b}.n)"


def _may_be_alike(a: str, b: str) -> str:
    """False only if the parities of two sets differ in more bits than near copies have shingles of one only."""
    up, down = ALIKE
    bits = " + ".join(f"bit_count({a}.odd[{i}] ^ {b}.odd[{i}])" for i in range(PARTS))
    return f"{up + down} * ({bits}) <= {down - up} * ({a}.n + {b}.n)"


def not_far_apart(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) but those whose wide parities show that they are no near copies."""
    up, down = ALIKE
    left, right = (nodes.select(F.col("node").alias(c), F.struct("odd", "wide", "n").alias(o)) for c, o in (("a", "p"), ("b", "q")))
    # the short parities are asked inside the join, so that it makes rows of few pairs
    both = pairs.join(left, "a").join(right, "b").where(_may_be_alike("p", "q")).withColumn("apart", bits_apart("p.wide", "q.wide"))
    return both.where(f"{up + down} * apart <= {down - up} * (p.n + q.n)").select("a", "b")


def fingerprint_pairs(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), candidates: each node with the first of its fingerprint, and the first ones of fingerprints that the anchors link."""
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first_node"))
    same = nodes.join(firsts, "fp").where("node <> first_node").select(F.col("first_node").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(firsts.select("fp"), max_bits)
    x, y = (firsts.select(F.col("fp").alias(fp), F.col("first_node").alias(node)) for fp, node in (("a", "x"), ("b", "y")))
    return same.unionByName(links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b), near copies, from which all components of near copies follow."""
    heads = nodes.select("node", "n", F.posexplode("head").alias("at", "shingle"))
    # the smallest place first: a text with few rare shingles before this one is near the middle of its group
    own = F.struct("at", "node", "n")
    shared = durable(heads.groupBy("shingle").agg(F.count("*").alias("many"), F.min(own).alias("p")).where("many > 1"))
    # a second key makes both sides shuffle, so that a shingle with very many texts can be split
    spare = F.xxhash64("shingle").alias("spare")
    met = ask_bloom(heads, "shingle", blocked_bloom(shared, "shingle"), "maybe").where("maybe").drop("maybe")
    placed = durable(met.select("*", spare).join(shared.select("shingle", "p", spare), ["shingle", "spare"]))
    stars = placed.select("shingle", own.alias("q"), "p").where(f"q.node <> p.node and {_could_be('p', 'q')}")
    stars = stars.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
    met_once = stars.unionByName(fingerprint_pairs(nodes)).distinct()
    stars = durable(not_far_apart(met_once, nodes))
    first = durable(alike(stars, docs, nodes))

    roots = connected_components(first).withColumnRenamed("root", "label")
    labelled = placed.drop("p").join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = durable(labelled)
    mixed = labelled.groupBy("shingle", "spare").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle", "spare")
    open_ = durable(labelled.join(mixed, ["shingle", "spare"], "left_semi").join(nodes.select("node", "odd"), "node"))
    left, right = (open_.select("shingle", "spare", F.struct("node", "n", "at", "label", "odd").alias(c)) for c in "pq")
    across = left.join(right, ["shingle", "spare"]).where(f"p.label < q.label and {_could_be('p', 'q')} and {_may_be_alike('p', 'q')}")
    pairs = across.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()
    rest = durable(not_far_apart(pairs.join(stars, ["a", "b"], "left_anti"), nodes))
    return first.unionByName(alike(rest, docs, nodes))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The first document of each component of near copies, in the columns of ``docs``."""
    rows = durable(shingle_rows(docs))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    nodes = durable(rows.groupBy("node", "fp", "n").agg(F.min(own).alias("first"), F.min("odd").alias("odd"), F.min("wide").alias("wide"), F.min("head").alias("head"), F.count("*").alias("many")))
    roots = connected_components(durable(near_links(docs, nodes)))
    linked = roots.join(nodes.select("node", "first"), "node")
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    # only texts of several rows or of a component move
    of_node = linked.join(best, "root").select("node", "best").unionByName(nodes.where("many > 1").join(roots, "node", "left_anti").select("node", F.col("first").alias("best")))
    spare = F.xxhash64("node").alias("spare")
    named = rows.select("node", "k1", "k2", spare).join(of_node.select("node", spare, F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2")), ["node", "spare"])
    told = durable(named.select("k1", "k2", F.expr("k1 = b1 and k2 = b2").alias("stays")))
    return keep_rows(docs, told)
