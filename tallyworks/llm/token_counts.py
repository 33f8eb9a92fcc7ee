"""Token counts by byte-pair merging with a heap and a linked list.

A word starts as its UTF-8 bytes. The adjacent pair of lowest rank is popped
from a heap and merged in a linked list until no ranked pair is left; the word's
token count is its initial symbols less the merges. No token ids are made.

Results by case: a null or empty text has 0 bytes and 0 tokens. A text of any
length is counted whole. Rows that repeat give repeated results; a null doc_id
stays null. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: Words whose counts a Python worker remembers; the memory is emptied when full.
MEMORY_WORDS = 300_000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def tokenizer_file(name: str) -> str:
    """The place of a tokenizer file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The number of symbols left when no adjacent pair has a rank."""
    count = len(symbols)
    after = list(range(1, count + 1))
    before = list(range(-1, count - 1))
    heap = []
    for i in range(count - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    last, left_over = count, count
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= last or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = left + right, ""
        left_over -= 1
        k = after[i] = after[j]
        if k < last:
            before[k] = i
            rank = ranks.get((symbols[i], symbols[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], symbols[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return left_over


class WordLengths(dict):
    """Token counts of words; a word that is missing is counted and remembered."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> int:
        n = merged_length(list(word.encode().decode("latin-1")), self.ranks)
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = n
        return n


class TokenCounter:
    """Counts the tokens of a text as the tokenizer of a byte-level ``.json`` file does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = {ord(letter): chr(b) for b, letter in byte_letters().items()}
        pairs = spec["model"]["merges"]
        ranks = {(a.translate(byte), b.translate(byte)): i for i, (a, b) in enumerate(pairs)}
        self.lengths = WordLengths(ranks)
        # \p{White_Space} where the pattern of the vocabulary has \s: the same set of characters
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        find, length = self.words.findall, self.lengths.__getitem__
        return len(parts) - 1 + sum(sum(map(length, find(part))) for part in parts)


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """The number of tokens of each whole text, as a column."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(tokenizer_file(tokenizer))
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, tokenizer).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
