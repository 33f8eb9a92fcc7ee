"""BPE encoding and decoding by batched numpy merge rounds.

The new words of a batch stand in one flat array of symbols. In each round the
adjacent pairs are looked up by binary search over the sorted pair keys, and
every word merges its pair of lowest rank wherever it occurs; words without a
ranked pair leave the array.

Results by case: a null or empty text has no tokens and decodes to the empty
text. A text of any length is encoded whole. Rows that repeat give repeated
results; a null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .token_counts import byte_letters, tokenizer_file

TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers; the memory is emptied when full.
MEMORY_WORDS = 300_000
#: Characters of text whose new words are merged in one flat array.
BLOCK_CHARS = 250_000
#: Fixed values: (first, last, what is added) of the letters that the library lower-cases and Python's tables don't.
LOWERED = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
#: Fixed values: (first, last) of code points that are letters or digits by the regex module's tables and not by the library's, which are older.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CF, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NO_RANK = np.iinfo(np.int32).max


class MergeTable:
    """Ranked pairs as sorted keys, for lookups by binary search."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.base = max(vocab.values()) + 1
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order].astype(np.int32)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of all words and each word's number of them."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        ended_words, ended_symbols = [], []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            key = symbols[:-1].astype(np.int64) * self.base + symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), NO_RANK, dtype=np.int32)
            rank[:-1] = np.where((self.keys[place] == key) & (word[1:] == word[:-1]), self.ranks[place], NO_RANK)
            size = np.diff(np.r_[first, len(symbols)])
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            ended = least == NO_RANK
            ended_words.append(word[ended])
            ended_symbols.append(symbols[ended])
            at = np.flatnonzero((rank == least) & ~ended)
            if len(at):  # of overlapping occurrences (a a a), the first, third, ... merge
                starts = np.r_[True, np.diff(at) > 1]
                since = at - np.repeat(at[starts], np.diff(np.r_[np.flatnonzero(starts), len(at)]))
                at = at[since % 2 == 0]
                symbols[at] = self.made[place[at]]
            keep = ~ended
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not ended_words:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        words, out = np.concatenate(ended_words), np.concatenate(ended_symbols)
        return out[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(lengths))


class WordBpe:
    """Encodes and decodes as the tokenizer of a ``.json`` file with word ends does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.table = MergeTable(vocab, spec["model"]["merges"])
        letters, end = byte_letters(), spec["model"]["end_of_word_suffix"]
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int32)
        self.specials = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        names = vocab | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = np.empty(max(names.values()) + 1, dtype=object)
        for name, i in names.items():
            self.names[i] = name
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        newer = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in NEWER)
        self.newer = regex.compile(f"[{newer}]")
        self.exact = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{newer}]]+|[\p{{N}}--[{newer}]]|[^\p{{White_Space}}[[\p{{L}}\p{{N}}]--[{newer}]]]+")
        self.lowered = {c: c + n for a, b, n in LOWERED for c in range(a, b + 1)}
        self.memory: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token's string is one word as it stands."""
        words: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                words.append(part)
            elif part:
                # lower case letter by letter: a final sigma has no form of its own
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                if plain.isascii():
                    words += self.words.findall(plain)
                else:
                    plain = plain.translate(self.lowered)
                    words += (self.exact if self.newer.search(plain) else self.words).findall(plain)
        return words

    def learn(self, words: list[str]) -> None:
        """Merge words that are not in memory, all in one flat array."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(b) for b in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[flat]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[flat[last]]
        merged, counts = self.table.merge(symbols, lengths)
        data = merged.astype("<u4").tobytes()
        at = 0
        for word, n in zip(words, counts.tolist(), strict=True):
            self.memory[word] = data[at : at + 4 * n]
            at += 4 * n

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memory) > MEMORY_WORDS:
            self.memory.clear()
        self.memory |= self.specials
        split = [self.split(t) for t in texts]
        if new := set().union(*split).difference(self.memory):
            self.learn(sorted(new))
        return [b"".join(map(self.memory.__getitem__, words)) for words in split]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        block, chars = [], 0
        for text in texts:
            block.append(text or "")
            chars += len(block[-1])
            if chars >= BLOCK_CHARS:
                yield from self.encode_block(block)
                block, chars = [], 0
        yield from self.encode_block(block)

    def decode(self, ids: bytes) -> str:
        """The tokens joined by spaces: the file names no decoder."""
        return " ".join(self.names[np.frombuffer(ids, "<u4")].tolist())


def bpe_digest(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """A struct of n_tokens and the SHA-256 of the ids and of the decoded text."""

    # Arrow, not pandas: a batch has 10,000 texts, which would stand in memory a second time
    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = WordBpe(tokenizer_file(tokenizer))
        kind = pa.struct({"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})
        for texts in batches:
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()) for ids in bpe.encode(t.as_py() for t in texts)]
            yield pa.array(rows, kind)

    return digest(text)


def encode_texts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of each row."""

    @F.arrow_udf("ids array<int>, decoded string")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = WordBpe(tokenizer_file(tokenizer))
        kind = pa.struct({"ids": pa.list_(pa.int32()), "decoded": pa.string()})
        for texts in batches:
            rows = [(np.frombuffer(ids, "<u4").astype(np.int32), bpe.decode(ids)) for ids in bpe.encode(t.as_py() for t in texts)]
            yield pa.array(rows, kind)

    return docs.select("doc_id", coded("text").alias("c")).select("doc_id", "c.*")


def digest_texts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return docs.select("doc_id", bpe_digest(F.col("text"), tokenizer).alias("c")).select("doc_id", "c.*")
