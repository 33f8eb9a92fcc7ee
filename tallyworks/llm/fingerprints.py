"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``SIZE`` smallest hashes of a text's shingles of five words, in
ascending order. The smallest hashes of two sketches together are the sketch of
both texts together, so sketches merge across parts, and the share of them that
stands in both estimates resemblance. Texts of at most ``SIZE`` shingles are
compared exactly.

Results by case: a null text counts as empty; a text without words has an empty
sketch, which resembles another empty one wholly and any other not at all; fewer
than five words are one shingle. Words are lower-cased and parted by white space
of ASCII. Texts of any length are read whole. Rows that repeat give repeated
results. In the order of documents a null doc_id comes last, and rows of one
doc_id follow each other by a hash of their text. An empty table gives no rows.
Only doc_id (a number) and text are read, so other columns can have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
SIZE = 128
#: Ranges of doc_id for each shuffle partition.
RANGES_OF_PARTITION = 4
SPACE = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """The hash of each shingle, repeats included; a text of fewer words has one."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")

    def hashed(w: Column) -> Column:
        # a place behind the last word is null, which the hash passes over
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])))

    # as an element the words are cut once
    return F.transform(F.array(words), hashed)[0]


def smallest(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def sketch(text: Column, width: int = SHINGLE, size: int = SIZE) -> Column:
    """The bottom-k sketch of each whole text, an array of long."""
    return smallest(shingle_hashes(text, width), size)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """The estimated share of the union's shingles that both have."""
    least = merged(a, b, size)
    both = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """The estimated share of the shingles of ``a`` that ``b`` has too; 1 if there are none, null if none of the union's smallest is of ``a``."""
    least = merged(a, b, size)
    own = F.size(F.array_intersect(a, least))
    both = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(own > 0, both / own)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """The estimated number of distinct shingles; exact below ``size``."""
    place = (F.element_at(a, size).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / place)


def written(a: Column) -> Column:
    """A sketch as text, 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def sketch_texts(docs: DataFrame, width: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """doc_id, sketch and shingles (the estimated number of distinct ones) of each document."""
    read = docs.select("doc_id", sketch(F.col("text"), width, size).alias("sketch"))
    return read.withColumn("shingles", distinct_shingles(F.col("sketch"), size))


def merge_sketches(sketches: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """The keys and the sketch of all of a group's texts together.

    Each task hands on ``size`` hashes of a group at most, so a group of very many
    texts costs no more at its place than any other.
    """
    hashes = sketches.select(*keys, F.explode_outer("sketch").alias("hash")).distinct()
    order = Window.partitionBy(*keys).orderBy(F.col("hash").asc_nulls_last())
    least = hashes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))


def _searched(value: Column, cuts: list) -> Column:
    """How many of the descending ``cuts`` are larger than the value, by binary search."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    table = F.lit(cuts)
    larger = lambda at, step: (at + step <= len(cuts)) & (F.get(table, at + step - 1) > value)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(larger(at, step), at + step).otherwise(at))


def _ranges(docs: DataFrame, parts: int) -> DataFrame:
    """The number of each row's range, for rows with doc_id and tie: ascending in the order of documents.

    The bounds are quantiles of doc_id. A doc_id that is several quantiles at once,
    and null if it is frequent, has as many ranges of its own, by tie.
    """
    share = [i / parts for i in range(1, parts)] or [0.5]
    seen = docs.agg(F.percentile_approx("doc_id", share, F.lit(max(10_000, 8 * parts))).alias("cuts"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")).first()
    cuts = sorted(seen["cuts"] or [0], reverse=True)
    distinct = list(dict.fromkeys(cuts))
    own = [cuts.count(c) if cuts.count(c) > 1 else 0 for c in distinct]
    start, starts = 0, []
    for n in [*own, 0]:
        starts.append(start)
        start += 1 + n
    nulls = math.ceil(parts * seen["nulls"] / max(1, seen["rows"]))
    within = F.col("tie").cast("double") / 2.0**64 + 0.5
    part_of = lambda n: F.least(F.floor(within * n).cast("int"), n - 1)
    place = _searched(F.col("doc_id"), distinct)
    of_cut = F.when(F.get(F.lit(distinct), F.col("place")) == F.col("doc_id"), F.get(F.lit(own), F.col("place"))).otherwise(0)
    begun = F.get(F.lit(starts), F.col("place"))
    number = F.when(F.col("doc_id").isNull(), F.lit(start) + part_of(F.lit(max(1, nulls)))).when(of_cut > 0, begun + 1 + part_of(of_cut)).otherwise(begun)
    return docs.withColumn("place", place).withColumn("range", number).drop("place")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, its sketch, and text and sketch of the next document by descending doc_id (after the last: the first).

    Rows move once, to ranges of doc_id, with a copy of each range's first row for
    the range before it. What the driver reads is a few numbers a range.
    """
    parts = RANGES_OF_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = _ranges(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")), parts)
    tops = rows.groupBy("range").agg(F.max("doc_id").alias("doc_id"))
    tops = {r["range"]: r["doc_id"] for r in tops.collect()}  # a few numbers a range
    if not tops:
        return rows.select("doc_id", "text", F.array().cast("array<bigint>").alias("sketch"), F.lit("").alias("next_text"), F.array().cast("array<bigint>").alias("next_sketch"))
    known = sorted(tops)
    before = dict(zip(known, [known[-1], *known[:-1]], strict=True))
    some = next((v for v in tops.values() if v is not None), 0)
    at_top = F.col("doc_id").isNull() | (F.get(F.lit([some if tops.get(r) is None else tops[r] for r in range(known[-1] + 1)]), F.col("range")) == F.col("doc_id"))
    heads = rows.where(at_top)
    least = heads.groupBy("range").agg(F.min("tie").alias("least"))
    heads = heads.join(least, "range").where(F.col("tie") == F.col("least")).groupBy("range").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    copies = heads.select("doc_id", "text", "tie", F.get(F.lit([before.get(r, 0) for r in range(known[-1] + 1)]), F.col("range")).alias("range"), F.lit(True).alias("copy"))
    moved = rows.select("doc_id", "text", "tie", "range", F.lit(False).alias("copy")).unionByName(copies).repartition("range")
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "tie")
    sketched = moved.withColumn("sketch", sketch(F.col("text")))
    led = sketched.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return led.where(~F.col("copy")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and that of its edited text, whose last third is the next document's start."""
    length = F.length("text")
    third = F.floor(length / 3).cast("int")
    head = F.expr("substring(text, 1, n_chars - third)")
    edited = F.concat(head, F.expr("substring(next_text, 1, third)"))
    changed = with_next(docs).withColumn("n_chars", length).withColumn("third", third).withColumn("edited", edited)
    both = changed.withColumn("edited_sketch", sketch(F.col("edited")))
    own, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(own).alias("fingerprint"),
        written(other).alias("edited_fingerprint"),
        resemblance(own, other).alias("near_edited"),
        resemblance(own, following).alias("near_next"),
        containment(own, other).alias("contained_edited"),
        distinct_shingles(own).alias("n_shingles"),
    )
