"""Licence scans with a positional index of rare words.

The postings of the index are (word, notice, place), for each notice's words of
highest inverse document frequency, which is counted over all documents. A file's
occurrences of those words are joined with the postings (all of them, as a file can
hold many notices); each gives an offset at which the notice would stand. Where rare
words agree on offsets within a band, as words may have been added or left out
between them, the notice is aligned with the file's words (longest common
subsequence, bit-parallel) and its mandatory key phrases are checked. Three fixed
phrases are found besides, wherever they stand.

A text's licence words are found in one reading, which keeps their places. Only texts
with an agreed offset are read again, once each, and no text meets another.

Results by case: a null text counts as empty; a text without licence words has
no labels, score 0 and null first_word and last_word. Rows that repeat doc_id and
text are looked up once and give equal results, and a null doc_id stays null. Of two
notices of one label, or two places, the better share counts; of rare words with
equal frequencies the first by name is indexed. An empty table gives no rows. Only
doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bloom import ask_bloom, blocked_bloom, row_keys
from .common import durable
from .license_texts import COMMON, NOTICES

#: Words of a lower-cased text; the base phrases, their rarest words' places and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc by", 0, "cc-by"), ("general public license", 2, "gpl"), ("all rights reserved", 2, "reserved"))

RARE_OF_NOTICE = 8
AGREEING = 2
#: Offsets so near each other agree; so many words around a notice's place belong to it.
BAND = 3
LEAST_SHARE = 0.6
#: A notice has at most 60 words, as its alignment is one long.
LONGEST = max(len(text.split()) for _, text, _ in NOTICES)


def lower_ascii(text: Column) -> Column:
    """Lower case in which no letter but A to Z becomes a to z: the Kelvin sign is the only other one that would."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def vocabulary() -> list[str]:
    """The words that are looked for: those of notices but for common ones, and one of each base phrase."""
    words = {w for _, text, _ in NOTICES for w in text.split()} - COMMON
    return sorted(words | {text.split()[at] for text, at, _ in PHRASES})


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _phrase_places(hits: Column, words: Column, text: str, anchor: int, label: str) -> Column:
    phrase = text.split()

    def stands(hit: Column) -> Column:
        first = hit["at"] - anchor
        return (hit["word"] == phrase[anchor]) & (first >= 0) & (F.slice(words, F.greatest(first, F.lit(0)) + 1, F.lit(len(phrase))) == _strings(phrase))

    return F.transform(F.filter(hits, stands), lambda h: F.struct((h["at"] - anchor).cast("long").alias("first"), F.lit(label).alias("label")))


def licence_hits(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_words, hits (at, word) of the vocabulary and base (first, label) of the fixed phrases."""
    words = docs.select("doc_id", *row_keys(), words_of(F.col("text")).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary()), i)), lambda i: i.isNotNull())
    hits = F.transform(places, lambda i: F.struct(i.alias("at"), F.get("words", i).alias("word")))
    read = words.withColumn("hits", hits)
    base = F.concat(*[_phrase_places(F.col("hits"), F.col("words"), *p) for p in PHRASES])
    return read.select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"), "hits", base.alias("base"))


def notices(spark: SparkSession) -> DataFrame:
    """notice (its number), label, words, keys and masks (the bits of each word's places) of each notice: as many rows as NOTICES."""
    rows = []
    for i, (label, text, keys) in enumerate(NOTICES):
        masks = {}
        for place, word in enumerate(text.split()):
            masks[word] = masks.get(word, 0) | 1 << place
        rows.append((i, label, text.split(), list(keys), masks))
    return spark.createDataFrame(rows, "notice int, label string, words array<string>, keys array<string>, masks map<string,bigint>")


def rare_index(found: DataFrame) -> DataFrame:
    """word, notice, place, rank (from 0) and n_rare: each notice under its words of highest IDF over all documents.

    The highest IDF is the least number of documents that have the word.
    """
    held = found.select("k1", F.explode(F.array_distinct(F.col("hits.word"))).alias("word"))
    files = held.groupBy("word").agg(F.count_distinct("k1").alias("files"))  # at most one row a word of the vocabulary
    placed = notices(found.sparkSession).select("notice", F.posexplode("words").alias("place", "word")).where(~F.col("word").isin(sorted(COMMON)))
    counted = placed.join(files, "word", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    rank = F.dense_rank().over(Window.partitionBy("notice").orderBy("files", "word")) - 1
    ranked = counted.withColumn("rank", rank).where(F.col("rank") < RARE_OF_NOTICE)
    return ranked.withColumn("n_rare", F.max("rank").over(Window.partitionBy("notice")) + 1).select("word", "notice", "place", "rank", "n_rare")


def agreed_offsets(found: DataFrame, index: DataFrame) -> DataFrame:
    """k1, k2, notice and start: where rare words of a notice agree, within the band from there, that it would stand."""
    hits = found.select("k1", "k2", F.inline("hits"))
    met = hits.join(F.broadcast(index), "word")  # RARE_OF_NOTICE words a notice, at a few places each
    bit = F.call_function("shiftleft", F.lit(1), F.col("rank"))
    told = met.groupBy("k1", "k2", "notice", "n_rare", (F.col("at") - F.col("place")).alias("start")).agg(F.bit_or(bit).alias("agree"))
    near = Window.partitionBy("k1", "k2", "notice").orderBy("start").rangeBetween(0, BAND)  # a text's own offsets
    agreed = F.bit_count(F.bit_or("agree").over(near)) >= F.least(F.lit(AGREEING), F.col("n_rare"))
    return told.withColumn("agreed", agreed).where("agreed").select("k1", "k2", "notice", "start")


def common_words(span: Column, words: Column, masks: Column) -> Column:
    """The length of the longest common subsequence of ``span`` and a notice's words: the zeros that its bits end with."""
    every = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(words)) - 1

    def step(row: Column, word: Column) -> Column:
        met = row.bitwiseAND(F.coalesce(F.try_element_at(masks, word), F.lit(0).cast("long")))
        return (row + met).bitwiseOR(row - met).bitwiseAND(every)

    return F.size(words) - F.bit_count(F.aggregate(span, every, step))


def aligned(docs: DataFrame, found: DataFrame, index: DataFrame) -> DataFrame:
    """k1, k2, labels and score of the texts in which a notice stands."""
    wanted = durable(agreed_offsets(found, index)).groupBy("k1", "k2").agg(F.collect_list(F.struct("notice", "start")).alias("wanted"))  # a text's own offsets
    asked = ask_bloom(docs.select(*row_keys(), "text"), "k1", blocked_bloom(wanted, "k1"), "maybe").where("maybe")
    texts = asked.groupBy("k1", "k2").agg(F.min("text").alias("text")).join(wanted, ["k1", "k2"])

    def cut(words: Column) -> Column:
        def span(start: Column) -> Column:
            first, end = F.greatest(start - BAND, F.lit(0)), start + LONGEST + BAND
            return F.struct(first.alias("first"), F.slice(words, first + 1, F.greatest(end - first, F.lit(0))).alias("span"))

        return F.transform("wanted", lambda p: F.struct(p["notice"].alias("notice"), p["start"].alias("start"), span(p["start"]).alias("cut")))

    # as an element the words are cut once, not at each offset
    spans = texts.select("k1", "k2", F.inline(F.transform(F.array(words_of(F.col("text"))), cut)[0]))
    length = F.greatest(F.col("start") + F.size("words") + BAND - F.col("cut.first"), F.lit(0))
    both = spans.join(F.broadcast(notices(docs.sparkSession)), "notice").withColumn("span", F.slice("cut.span", F.lit(1), length))
    padded = F.concat(F.lit(" "), F.array_join("span", " "), F.lit(" "))
    verified = F.forall("keys", lambda k: F.contains(padded, F.concat(F.lit(" "), k, F.lit(" "))))
    same = common_words(F.col("span"), F.col("words"), F.col("masks"))
    rated = both.where(verified).select("k1", "k2", "label", (same / F.size("words")).alias("share")).where(F.col("share") >= LEAST_SHARE)
    return rated.groupBy("k1", "k2").agg(F.collect_set("label").alias("method"), F.max("share").alias("score"))  # as many labels as NOTICES


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: its base places, its labels and the best notice's share of matching words."""
    found = durable(licence_hits(docs))
    told = durable(aligned(docs, found, rare_index(found)))
    first, empty = F.transform("base", lambda p: p["first"]), F.array().cast("array<string>")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    def shown(method: Column, score: Column) -> list[Column]:
        base = F.transform("base", lambda p: p["label"])
        return [
            F.col("doc_id"),
            F.col("n_words"),
            F.size("base").cast("long").alias("n_base"),
            F.array_min(first).alias("first_word"),
            F.array_max(first).alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.concat(base, F.coalesce(method, empty))).alias("labels"),
            F.coalesce(score, F.lit(0.0)).alias("score"),
        ]

    # only rows of texts in which a notice may stand move
    asked = ask_bloom(found.select("doc_id", "k1", "k2", "n_words", "base"), "k1", blocked_bloom(told, "k1"), "maybe")
    clear = asked.where("not maybe").select(*shown(empty, F.lit(0.0)))
    # a second hash makes both sides shuffle, so that a text with very many rows can be split
    met = asked.where("maybe").join(told, ["k1", "k2"], "left")
    return clear.unionByName(met.select(*shown(F.col("method"), F.col("score"))))


def scan_license_text(text: str | None, rare: dict[int, set[str]]) -> dict:
    """The same for one text in plain Python, for tests; ``rare`` has each notice's indexed words."""
    words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for p, _, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    shares = {}
    for n, (label, notice, keys) in enumerate(NOTICES):
        plain = notice.split()
        for start in range(-len(plain), len(words)):
            # the rare words that stand within the band from where this start puts them
            agree = {w for place, w in enumerate(plain) if w in rare[n] and w in words[max(start + place, 0) : max(start + place + BAND + 1, 0)]}
            here = any(w in rare[n] and words[max(start + place, 0) : max(start + place + 1, 0)] == [w] for place, w in enumerate(plain))
            span = words[max(start - BAND, 0) : max(start + len(plain) + BAND, 0)]
            if here and len(agree) >= min(AGREEING, len(rare[n])) and all(f" {k} " in f" {' '.join(span)} " for k in keys):
                lengths = [0] * (len(span) + 1)
                for word in plain:
                    above = 0
                    for i, other in enumerate(span, 1):
                        above, lengths[i] = lengths[i], above + 1 if word == other else max(lengths[i], lengths[i - 1])
                if lengths[-1] / len(plain) >= LEAST_SHARE:
                    shares[label] = max(lengths[-1] / len(plain), shares.get(label, 0))
    base = {label for _, label in places}
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": places[0][0] if places else None,
        "last_word": places[-1][0] if places else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | set(shares))),
        "score": max(shares.values(), default=0.0),
    }
