"""SimHash near-duplicates by anchor-point covering.

A fingerprint's first 46 bits are two words of 23 bits, and each is at most 3
bits from one codeword of the binary Golay code. The pair of codewords is the
fingerprint's home anchor. If y differs from x in at most t bits, y is within
covering radius plus t of x's home, split over the two words as 3+i and 3+j
bits with i+j <= t. So each fingerprint is replicated to every such anchor,
and each anchor compares its replicas with the fingerprints at home there:
no link can be missed, and only links of at most t bits pass.

Results by case: a null or empty text, or one without words, has fingerprint
zero and is linked like any other. Texts of one fingerprint are one node, so
copies are never expanded into pairs. Rows that repeat give repeated results. A
null doc_id is larger than every other when a component is named. Only doc_id
and text are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16

WORD = 23
RADIUS = 3
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width)), strict=False))
    digest, ones, count = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0
    while block := [digest(s, seed) for s in islice(shingles, BLOCK)]:
        hashes = np.array(block, dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(block)
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int(bits.view("<u8")[0])


def simhash(text: Column, width: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint of each whole text as a signed long with the same bits."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width, seed) for t in texts], dtype="u8").view("i8"))

    return fingerprints(text)


class GolayAnchors:
    """The codewords near any word of 23 bits, by its syndrome."""

    def __init__(self, extra: int):
        self.extra = extra
        self.rest = [self._remainder(1 << i) for i in range(WORD)]
        low, high = 12, WORD - 12
        self.low = self._table(self.rest[:low])
        self.high = self._table(self.rest[low : low + high])
        patterns = [(w, reduce(int.__or__, (1 << i for i in at), 0)) for w in range(RADIUS + extra + 1) for at in combinations(range(WORD), w)]
        weight, pattern = (np.array(x, dtype=np.int64) for x in zip(*patterns, strict=True))
        syndrome = self.syndrome(pattern)
        order = np.lexsort((weight, syndrome))
        self.pattern = pattern[order]
        self.start = np.searchsorted(syndrome[order], np.arange(2049))
        #: reach[e][s]: how many patterns of syndrome s have at most RADIUS + e bits
        self.reach = [np.bincount(syndrome[weight <= RADIUS + e], minlength=2048) for e in range(extra + 1)]

    @staticmethod
    def _remainder(word: int) -> int:
        for i in range(WORD - 1, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    @staticmethod
    def _table(columns: list[int]) -> np.ndarray:
        table = np.zeros(1, dtype=np.int64)
        for c in columns:
            table = np.concatenate([table, table ^ c])
        return table

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def home(self, words: np.ndarray) -> np.ndarray:
        return words ^ self.pattern[self.start[self.syndrome(words)]]

    def near(self, words: np.ndarray, e: int, past: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(index, codeword) of all codewords within RADIUS + e bits, beyond RADIUS + past if that is given."""
        s = self.syndrome(words)
        skip = self.reach[past][s] if past >= 0 else np.zeros(len(s), dtype=np.int64)
        n = self.reach[e][s] - skip
        index = np.repeat(np.arange(len(words)), n)
        within = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
        return index, words[index] ^ self.pattern[(self.start[s] + skip)[index] + within]


def replicas(fps: np.ndarray, code: GolayAnchors) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of every anchor that a fingerprint is replicated to."""
    first, second = fps & 0x7FFFFF, fps >> WORD & 0x7FFFFF
    parts = []
    for i in range(code.extra + 1):  # the first word is i bits past the radius, the second at most what is left
        a_index, a = code.near(first, i, i - 1)
        b_index, b = code.near(second[a_index], code.extra - i)
        parts.append((a_index[b_index], a[b_index] << WORD | b))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def home_anchors(fps: np.ndarray, code: GolayAnchors) -> np.ndarray:
    return code.home(fps & 0x7FFFFF) << WORD | code.home(fps >> WORD & 0x7FFFFF)


def anchor_table(fps: DataFrame, max_bits: int) -> DataFrame:
    """anchor, fp and is_home: every distinct fingerprint at each anchor that may hold a link of it."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = GolayAnchors(max_bits)
        for batch in batches:
            values = batch["fp"].to_numpy()
            index, anchor = replicas(values, code)
            yield pd.DataFrame({"anchor": anchor, "fp": values[index], "is_home": anchor == home_anchors(values, code)[index]})

    return fps.mapInPandas(spread, "anchor long, fp long, is_home boolean")


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b for all distinct fingerprints that differ in at most ``max_bits`` bits.

    A fingerprint has no more neighbours than there are patterns of that many
    bits (2,080 for 2), so the links grow with the fingerprints, not their square.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = durable(anchor_table(fps.repartition(parts), max_bits))  # a fingerprint becomes about 60 rows
    homes = table.where("is_home").select("anchor", F.col("fp").alias("a"))
    others = table.select("anchor", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return homes.join(others, "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b")


def simhash_components(docs: DataFrame, max_bits: int = MAX_BITS, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable by links."""
    rows = durable(docs.select("doc_id", simhash(F.col("text"), width, seed).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = fingerprint_links(nodes.select("fp"), max_bits)
    roots = connected_components(links)
    linked = durable(roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "first_id"))
    named = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_linked = linked.join(named, "root").select(F.col("node").alias("fp"), "component_id", F.lit(0).alias("rank"))
    of_all = of_linked.unionByName(nodes.select("fp", F.col("first_id").alias("component_id"), F.lit(1).alias("rank")))
    of_fp = of_all.groupBy("fp").agg(F.min_by("component_id", "rank").alias("component_id"))
    # a second key makes both sides shuffle, so that a fingerprint with very many rows can be split
    spare = F.xxhash64("fp").alias("spare")
    return rows.select("*", spare).join(of_fp.select("*", spare), ["fp", "spare"]).select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, the fingerprint in 16 hexadecimal digits and component_id."""
    found = simhash_components(docs, max_bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The doc_id of every document that is not the first of its component."""
    return simhash_components(docs, max_bits).where("doc_id <> component_id").select("doc_id")
