"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with
other numbers or names keeps its template. Windows of the template's words are
joined by hash with those of all documents. On each diagonal (document place
less item place) the values behind the placeholders must be consistent: one
value of the item stands for one value of the document, and the other way round.
Windows that hold a value of which this is not true don't count, unless their
words are those of the item. A document is contaminated by an item if the windows
that count cover enough of it.

Each word keeps its value behind a mark, and three templates are read off the marks. In the
first, a name is a word with one capital after a lower-case word. In the second it is
any word with one capital, as the first of a sentence, line or quotation can be
a name; of an item's windows there, those count of which a third or more is no
placeholder. The third has no names, for copies in lower case, capitals or title
case. A number can have separators and decimals; a unit is a word of a fixed
list after a number. An item of fewer words than a window is one
window of its own length; one of fewer than LEAST_WORDS words is no evidence.

A document and an item are compared only if they share one of the item's rarest
windows, so many of them that no contamination is without one (``rare_windows``).
The windows move as hashes and places only; the words behind the placeholders are
read once more, from the documents that met a window, once for each text.

Results by case: null and empty texts match nothing. Repeated rows of a
document or an item are one. A null doc_id is reported as null, a null item_id
not at all. Empty tables give no rows. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import ask_bloom, blocked_bloom, keep_rows, row_keys
from .common import durable

WINDOW = 8
LEAST_WORDS = 4
LEAST_COVERAGE = 0.25
#: Item windows that are broadcast; more are joined by shuffle, behind a Bloom filter of bounded size.
BROADCAST_WINDOWS = 200_000

#: Marks before a name, a number, a unit and a word that is a name in the second template, and the point in a number.
NAME, NUMBER, UNIT, FIRST, POINT = "\uE0F0", "\uE0F1", "\uE0F2", "\uE0F3", "\uE0F4"
#: Fixed values.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hour hours minute minutes second seconds day days week weeks month months year years cent cents dollar dollars euro euros percent mph kmh w kw v hz byte bytes kb mb gb".split()
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
NO_WORD = r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
#: Of so many words of a window in the second template, one at least is no placeholder.
LITERAL_OF = 3


def marked_words(text: Column) -> Column:
    """The words in lower case; a number is one word, the letters behind it are another, and names, numbers and units have a mark before them."""
    # each pattern begins with what it takes, which is rare, and looks back from there
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), r"([0-9])(?=\p{L})", "$1 ")
    whole = F.regexp_replace(apart, r",(?<=[0-9],)(?=[0-9]{3}(?![0-9]))", "")
    joined = F.regexp_replace(whole, r"[.,](?<=[0-9][.,])(?=[0-9])", POINT)
    named = F.regexp_replace(joined, r"(\p{Lu}(?<=\p{Ll},? \p{Lu})\p{Ll}+)", f"{NAME}$1")
    named = F.regexp_replace(named, rf"(\p{{Lu}}(?<!{LETTER}\p{{Lu}})\p{{Ll}}+)(?!{LETTER})", f"{FIRST}$1")
    numbered = F.regexp_replace(F.lower(named), rf"([0-9](?<!{WORD[:-1]}[0-9])[0-9]*(?:{POINT}[0-9]+)*){NO_WORD}", f"{NUMBER}$1")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    measured = F.regexp_replace(numbered, rf"({NUMBER}[0-9{POINT}]+ )[{NAME}{FIRST}]?({units}){NO_WORD}", f"$1{UNIT}$2")
    return F.regexp_extract_all(measured, F.lit(WORD), F.lit(0))


def _plain(word: Column) -> Column:
    return F.ltrim(word, F.lit(NAME + NUMBER + UNIT + FIRST))


def _template(word: Column, kind: int) -> Column:
    """A word of the first, second or third template (0, 1, 2)."""
    measured = F.when(word.startswith(NUMBER), NUMBER).when(word.startswith(UNIT), UNIT)
    if kind < 2:
        measured = measured.when(word.startswith(NAME), NAME)
    if kind == 1:
        measured = measured.when(word.startswith(FIRST), NAME)
    return measured.otherwise(_plain(word))


TEMPLATES = ("one", "two", "three")


def _hashes(words: Column, kind: int) -> Column:
    """The hash of each word in a template; words without a mark are most, and are not looked at further."""
    return F.transform(words, lambda w: F.when((w < NAME) | (w > POINT), F.xxhash64(w)).otherwise(F.xxhash64(_template(w, kind))))


def _joined(left: Column, right: Column, start: int) -> Column:
    """The hash of each pair (element of ``left``, element of ``right`` that stands ``start`` further)."""
    later = F.slice(right, F.lit(start + 1), F.size(right))
    return F.zip_with(F.slice(left, F.lit(1), F.greatest(F.size(right) - start, F.lit(0))), later, lambda a, b: F.xxhash64(a, b))


def _window_hashes(hashes: Column, width: int) -> Column:
    """The hash of each window of words: that of its two parts, of which the first is a power of two wide."""
    if width == 1:
        return hashes
    first = 1 << ((width - 1).bit_length() - 1)
    # as elements the parts are worked out once
    if 2 * first == width:
        return F.transform(F.array(_window_hashes(hashes, first)), lambda h: _joined(h, h, first))[0]
    parts = F.struct(_window_hashes(hashes, first).alias("left"), _window_hashes(hashes, width - first).alias("right"))
    return F.transform(F.array(parts), lambda p: _joined(p["left"], p["right"], first))[0]


def windows(words: Column, widths: list[int]) -> Column:
    """An array of (at, one, two, three): each window's place and its hash in the three templates."""

    def hashed(w: Column) -> Column:
        return F.struct(*[_hashes(w, k).alias(c) for k, c in enumerate(TEMPLATES)])

    def cut(h: Column) -> Column:
        every = []
        for width in widths:
            places = F.sequence(F.lit(0), F.size(h["one"]) - width).alias("at")
            some = F.arrays_zip(places, *[_window_hashes(h[c], width).alias(c) for c in TEMPLATES])
            every.append(F.when(F.size(h["one"]) >= width, some).otherwise(F.array().cast("array<struct<at:int,one:bigint,two:bigint,three:bigint>>")))
        return F.concat(*every)

    # as elements the words and their hashes are worked out once
    return F.transform(F.transform(F.array(words), hashed), cut)[0]


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, width, at, n_windows, window (its hash), plain (the hash of its words) and slots (place, mark, value) of each window."""
    read = items.where("item_id is not null").select("item_id", marked_words(F.col("text")).alias("words"))
    sized = read.where(F.size("words") >= LEAST_WORDS).withColumn("width", F.least(F.size("words"), F.lit(WINDOW)))
    every = None
    for width in range(LEAST_WORDS, WINDOW + 1):
        cut = sized.where(F.col("width") == width).select("item_id", "words", "width", (F.size("words") - width + 1).alias("n_windows"), F.inline(windows(F.col("words"), [width])))
        cut = cut.select("item_id", "width", "n_windows", "at", *TEMPLATES, F.slice("words", F.col("at") + 1, F.lit(width)).alias("cut"))
        every = cut if every is None else every.unionByName(cut)

    def slots_of(kind: int) -> Column:
        named = F.transform("cut", lambda w, i: F.struct(i.alias("place"), _template(w, kind).alias("mark"), _plain(w).alias("value")))
        return F.filter(named, lambda s: s["mark"].isin(NAME, NUMBER, UNIT))

    plain = F.xxhash64(F.transform("cut", lambda w: F.xxhash64(_plain(w)))).alias("plain")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("window"), slots_of(k).alias("slots")) for k, c in enumerate(TEMPLATES)])
    told = every.select("item_id", "width", "n_windows", "at", plain, F.inline(kinds))
    told = told.where((F.col("kind") != 1) | ((F.col("width") - F.size("slots")) * LITERAL_OF >= F.col("width")))
    return told.drop("kind").distinct()


def rare_windows(listed: DataFrame, least_coverage: float) -> DataFrame:
    """item_id, n_windows and window of the places of each item whose windows the fewest items have.

    They are all places but one fewer than those that have to be met, so a document that
    meets enough of an item's places meets one of these. A phrase that many items share
    is thus no key, unless it alone is enough of an item.
    """
    items = listed.groupBy("window").agg(F.count_distinct("item_id").alias("items"))
    place = Window.partitionBy("item_id", "n_windows", "at")
    ranked = Window.partitionBy("item_id", "n_windows").orderBy("most", "at")  # an item's own windows
    counted = listed.select("item_id", "n_windows", "at", "window").join(items, "window").withColumn("most", F.max("items").over(place))
    need = F.greatest(F.ceil(F.col("n_windows") * least_coverage - 1e-9), F.lit(1))
    rare = counted.withColumn("rank", F.dense_rank().over(ranked)).where(F.col("rank") <= F.col("n_windows") - need + 1)
    return rare.select("item_id", "n_windows", "window").distinct()


def met_windows(docs: DataFrame, listed: DataFrame, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, k1, k2, doc_at and the item's window, for each window that a document and an item have, of the pairs that share a rare one."""
    total = listed.count()
    widths = sorted(r["width"] for r in listed.select("width").distinct().collect())  # WINDOW and fewer
    if not widths:
        return docs.select("doc_id", *row_keys(), F.lit(0).alias("doc_at")).limit(0).join(listed, F.lit(False))
    few = F.broadcast if total <= BROADCAST_WINDOWS else lambda table: table
    # the keys are made below the windows, so once a text
    words = docs.where("text is not null").select("doc_id", *row_keys(), marked_words(F.col("text")).alias("words"))
    read = words.select("doc_id", "k1", "k2", F.inline(windows(F.col("words"), widths)))
    one_only = F.expr("one = two and one = three")
    hashes = F.when(one_only, F.array("one")).otherwise(F.array_distinct(F.array(*TEMPLATES)))
    cut = read.select("doc_id", "k1", "k2", F.col("at").alias("doc_at"), F.explode(hashes).alias("window"))
    if total > BROADCAST_WINDOWS:
        cut = ask_bloom(cut, "window", blocked_bloom(listed, "window"), "maybe").where("maybe").drop("maybe")
    # one row for each window of a document, whatever the number of items that have it;
    # rows that repeat id and text become one before they move
    hits = durable(cut.join(few(listed.select("window").distinct()), "window").distinct())
    pairs = hits.join(few(rare_windows(listed, least_coverage)), "window").select("k1", "k2", "item_id", "n_windows").distinct()
    return pairs.join(few(listed), ["item_id", "n_windows"]).join(hits, ["k1", "k2", "window"]).drop("window")


def words_behind(docs: DataFrame, met: DataFrame) -> DataFrame:
    """k1, k2, doc_at, width and theirs (the words) of each window of ``met`` that has placeholders."""
    wanted = met.where(F.size("slots") > 0).groupBy("k1", "k2").agg(F.collect_set(F.struct("doc_at", "width")).alias("wanted"))  # a text's own places
    keyed = docs.where("text is not null").select(*row_keys(), "text")
    some = ask_bloom(keyed, "k1", blocked_bloom(wanted, "k1"), "maybe").where("maybe").drop("maybe")
    texts = some.groupBy("k1", "k2").agg(F.min("text").alias("text")).join(wanted, ["k1", "k2"])
    plain = F.transform(marked_words(F.col("text")), _plain)

    def cut(words: Column) -> Column:
        return F.transform("wanted", lambda p: F.struct(p["doc_at"].alias("doc_at"), p["width"].alias("width"), F.slice(words, p["doc_at"] + 1, p["width"]).alias("theirs")))

    # as an element the words are cut once, not at each window
    return texts.select("k1", "k2", F.inline(F.transform(F.array(plain), cut)[0]))


def leaks(docs: DataFrame, items: DataFrame, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, k1, k2 (the row's keys), item_id, of_item (its windows), n_windows (those that count) and coverage of each leak."""
    met = durable(met_windows(docs, durable(item_windows(items)), least_coverage))
    own, nothing = ["doc_id", "k1", "k2", "item_id", "n_windows"], F.array().cast("array<struct<a:string,b:string>>")
    diagonal = (F.col("doc_at") - F.col("at")).alias("diagonal")
    pairs = F.transform("slots", lambda s: F.struct(F.concat(s["mark"], s["value"]).alias("a"), F.concat(s["mark"], F.get("theirs", s["place"])).alias("b")))
    same = (F.xxhash64(F.transform("theirs", lambda w: F.xxhash64(w))) == F.col("plain")).alias("same")
    read = met.where(F.size("slots") > 0).join(words_behind(docs, met), ["k1", "k2", "doc_at", "width"])
    valued = read.select(*own, diagonal, F.struct("at", same, pairs.alias("slots")).alias("met"))
    literal = met.where(F.size("slots") == 0).select(*own, diagonal, F.struct("at", F.lit(True).alias("same"), nothing.alias("slots")).alias("met"))
    # a diagonal holds one copy of the item at most, so its windows are as few as the item's
    lines = valued.unionByName(literal).groupBy(*own, "diagonal").agg(F.collect_set("met").alias("met"))
    lines = lines.withColumn("slots", F.array_distinct(F.flatten("met.slots")))
    one_to_one = reduce(Column.__and__, [F.size(F.array_distinct(F.col(f"slots.{c}"))) == F.size("slots") for c in "ab"])
    crossed = F.filter("slots", lambda s: F.exists("slots", lambda r: (r["a"] == s["a"]) != (r["b"] == s["b"])))
    unclear = F.when(one_to_one, nothing).otherwise(crossed)
    counted = F.filter("met", lambda w: w["same"] | ~F.arrays_overlap(w["slots"], F.col("unclear")))
    by_item = lines.withColumn("unclear", unclear).select(*own, F.explode(counted).alias("met")).select(*own, "met.at")
    covered = by_item.groupBy("doc_id", "k1", "k2", "item_id", F.col("n_windows").alias("of_item")).agg(F.count_distinct("at").alias("n_windows"))
    rated = covered.withColumn("coverage", F.col("n_windows") / F.col("of_item"))
    return rated.where(F.col("coverage") >= least_coverage).select("doc_id", "k1", "k2", "item_id", "of_item", "n_windows", "coverage")


def contaminated(docs: DataFrame, items: DataFrame, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows (of the item, found with consistent values) and coverage of each contamination; of texts of one doc_id the one that covers most."""
    found = leaks(docs, items, least_coverage).groupBy("doc_id", "item_id", "of_item").agg(F.max("n_windows").alias("n_windows"), F.max("coverage").alias("coverage"))
    return found.select("doc_id", "item_id", "n_windows", "coverage")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no item contaminates, in their own columns."""
    told = durable(leaks(docs, items).select("k1", "k2", F.lit(False).alias("stays")).distinct())
    return keep_rows(docs, told, once=False)
