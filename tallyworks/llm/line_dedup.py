"""Near-duplicate lines by a segment-partition edit join.

Two lines are linked if at most MAX_EDITS code points differ (insert, delete or
replace), and of the longer line at most one in CHARS_OF_EDIT. So with k edits
allowed, a line is split into k + 1 segments; if it is linked to a line
that is as long or longer, one of its segments stands there unchanged, at one of a
few places that the two lengths allow. So each segment is indexed by its line's
length, number and text, and each line probes the index with its substrings at
those places. Lines that meet must have nearly the same counts of some letters, which
the join compares before it makes a row; a banded bit-parallel edit distance
verifies the rest.

Each different text is one node, so copies of a line are never expanded into
pairs. A line that is certainly single gives its keys where it is read; only those
that may repeat, by a Bloom filter of bounded size, move to be made one. The join
moves hashes, and the few texts to verify are picked out of the documents by
another such filter.

Results by case: null and empty texts have no lines, and empty lines are not
listed. Lines of fewer than CHARS_OF_EDIT code points are linked to equal ones only.
A line's first place is the smallest (doc_id, line number), and a null doc_id is
smaller than all; among rows of one doc_id a hash of the text decides. Rows that
repeat doc_id and text add to a line's copies and are otherwise one. Empty tables
give no rows. Only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import ask_bloom, blocked_bloom
from .common import durable
from .components import connected_components

MAX_EDITS = 2
#: Of so many code points of the longer line, one at most may differ: in a shorter line an edit says too little.
CHARS_OF_EDIT = 4


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (the text's hash), line_no (from 0) and line of every line that is not empty."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("lines"))
    # outer, as Spark would otherwise split each text twice more to see whether it has lines; a null line goes with the empty ones
    return keyed.select("doc_id", "text_key", F.posexplode_outer("lines").alias("line_no", "line")).where("line <> ''")


def _allowed(length: Column, max_edits: int, chars_of_edit: int) -> Column:
    """How many edits a line of this length may be from a shorter one."""
    return F.least(F.lit(max_edits), F.floor(length / chars_of_edit).cast("int"))


def _key(line: Column) -> tuple[Column, Column]:
    """Two hashes with different seeds: 128 bits that stand for the line."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")


#: Letters whose counts the join compares: the frequent ones of Latin scripts.
COUNTED = "etaoinshrdlucmfw"
#: A count modulo 8 as four bits; two counts that are d apart differ in d bits at most.
COUNT_CODE = (0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000)
#: One edit changes two counts by one (a letter becomes another), or one count.
BITS_OF_EDIT = 2

def letter_counts(line: Column) -> Column:
    """The counts of the letters COUNTED, coded in one long: lines that differ in k edits differ in at most 2 k bits.

    A letter is counted by what its removal takes off and stays removed, so that each pass is shorter than the one before.
    """
    code = F.array(*[F.lit(c).cast("long") for c in COUNT_CODE])

    def step(state: Column, letter: Column) -> Column:
        def count(left: Column) -> Column:
            n = F.octet_length(state["rest"]) - F.octet_length(left)
            return F.struct(left.alias("rest"), F.shiftleft(state["bits"], 4).bitwiseOR(F.get(code, n.bitwiseAND(7))).alias("bits"))

        return _with(F.replace(state["rest"], letter, F.lit("")), count)

    begin = F.struct(line.alias("rest"), F.lit(0).cast("long").alias("bits"))
    return F.aggregate(F.array(*[F.lit(c) for c in COUNTED]), begin, step, lambda state: state["bits"])


def line_places(docs: DataFrame) -> DataFrame:
    """h1, h2, first (doc_id, line_no, text_key) and n_copies of each different line."""
    return split_lines(docs).groupBy(*_key(F.col("line"))).agg(F.min(F.struct("doc_id", "line_no", "text_key")).alias("first"), F.count("*").alias("n_copies"))


def single_lines(docs: DataFrame, places: DataFrame, least_chars: int) -> tuple[DataFrame, DataFrame]:
    """h1 and line of the different lines of at least ``least_chars`` code points: those that stand once, and those that may repeat."""
    lines = split_lines(docs).where(F.length("line") >= least_chars).select(*_key(F.col("line")), "line")
    asked = ask_bloom(lines, "h1", blocked_bloom(places.where("n_copies > 1"), "h1"), "maybe")
    several = asked.where("maybe").groupBy("h1", "h2").agg(F.min("line").alias("line"))
    return asked.where("not maybe").select("h1", "line"), several.select("h1", "line")


#: What a key is for: its line's index, both, or its line's probes.
INDEX, BOTH, PROBE = 0, 1, 2


def _shapes(max_edits: int) -> Column:
    """An array of (k, shorter, number, move): a segment of a line that is shorter by so many, moved by so many, with k edits."""
    shapes = []
    for k in range(1, max_edits + 1):
        for shorter in range(k + 1):
            for i in range(k + 1):
                # edits before the segment move it by i at most, those behind it by k - i
                shapes += [(k, shorter, i, move) for move in range(max(-i, shorter - k + i), min(i, shorter + k - i) + 1)]
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("k", "shorter", "number", "move"), s, strict=True)]) for s in shapes])


def segment_keys(lines: DataFrame, max_edits: int, chars_of_edit: int) -> DataFrame:
    """h1, letters, segment and use of each line's keys: its segments, and the substrings that a linked line, as long or shorter, may have as a segment.

    Code points stand as four bytes each, so that a substring is found without reading what is before it.
    """
    read = lines.select("h1", letter_counts(F.col("line")).alias("letters"), F.encode(F.make_valid_utf8("line"), "UTF-32").alias("code"))
    read = read.withColumn("n", (F.octet_length("code") / 4).cast("int"))
    each = read.select("*", F.inline(_shapes(max_edits))).withColumn("allowed", _allowed(F.col("n"), max_edits, chars_of_edit))
    k, number, move, length = F.col("k"), F.col("number"), F.col("move"), F.col("n") - F.col("shorter")
    own, probing = F.expr("shorter = 0 and move = 0"), F.col("allowed") == k
    indexed = own & (F.col("allowed") <= k) & (_allowed(F.col("n") + k, max_edits, chars_of_edit) >= k)
    # the line is cut into k + 1 segments; the last ones take what is left over
    base, rest = (length / (k + 1)).cast("int"), length % (k + 1)
    start = number * base + F.greatest(F.lit(0), number - k - 1 + rest) + move
    size = base + (number >= k + 1 - rest).cast("int")
    key = F.xxhash64(k, number, length, F.substring(F.col("code"), 4 * start + 1, 4 * size)).alias("segment")
    use = F.when(~own, PROBE).when(probing, BOTH).otherwise(INDEX).alias("use")
    return each.where(F.when(own, indexed).otherwise(probing & (start >= 0))).select("h1", "letters", key, use)


#: Powers of two down from 2^30, for the search of a common start.
STEPS = [1 << i for i in range(30, -1, -1)]


def common_start(a: Column, b: Column) -> Column:
    """How many code points two strings have in common at their start."""
    most = F.least(F.length(a), F.length(b))

    def step(p: Column, k: Column) -> Column:
        return F.when((p + k <= most) & (F.substring(a, p + 1, k) == F.substring(b, p + 1, k)), p + k).otherwise(p)

    return F.aggregate(F.array(*[F.lit(k) for k in STEPS]), F.lit(0), step)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def banded_distance(a: Column, b: Column, max_edits: int) -> Column:
    """The edit distance of two strings if it is ``max_edits`` or less, else something larger.

    The band of 2 * max_edits + 1 rows about the diagonal is one word of bits, after Hyyrö
    (2003): bit r of column j is row j - max_edits + r. ``up`` and ``down`` hold the rows
    whose value is one more or one less than that of the row above. The value is
    followed down the lowest diagonal to the last row, then along it; it can fall by
    the columns that are left then, so beyond that and ``max_edits`` nothing more is worked out.
    """
    both = F.struct(F.split(a, "").alias("rows"), F.split(b, "").alias("columns"), F.length(a).alias("m"), F.length(b).alias("n"))
    # as an element the letters are split once, not at each step
    return F.transform(F.array(both), lambda x: _banded(x["rows"], x["columns"], x["m"], x["n"], max_edits))[0]


def _banded(rows: Column, columns: Column, m: Column, n: Column, max_edits: int) -> Column:
    band = 2 * max_edits + 1
    full = (1 << band) - 1
    begin = F.struct(F.lit(full >> max_edits << max_edits).alias("up"), F.lit(0).alias("down"), F.least(m, F.lit(max_edits)).alias("value"), F.lit(0).alias("j"))

    def invert(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(full))

    def step(state: Column, letter: Column) -> Column:
        j = state["j"] + 1
        same = F.lit(0)
        for r in range(band):
            place = j - max_edits + r - 1
            same = same + F.when((place >= 0) & (F.get(rows, place) == letter), 1 << r).otherwise(0)
        packed = F.struct(j.alias("j"), same.alias("same"), state["up"].alias("up"), state["down"].alias("down"), state["value"].alias("value"))
        return F.when(state["value"] > 2 * max_edits + n - m, state).otherwise(F.transform(F.array(packed), advance)[0])

    def advance(s: Column) -> Column:
        sums = (s["same"].bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])
        diagonal = sums.bitwiseOR(s["same"]).bitwiseOR(s["down"]).bitwiseAND(F.lit(full))
        packed = F.struct(s["j"].alias("j"), s["value"].alias("value"), s["up"].alias("up"), s["down"].alias("down"), diagonal.alias("zero"))
        return F.transform(F.array(packed), finish)[0]

    def finish(s: Column) -> Column:
        right = s["down"].bitwiseOR(invert(s["zero"].bitwiseOR(s["up"])))
        left = s["zero"].bitwiseAND(s["up"])
        moved = F.shiftright(s["zero"], 1)
        at = F.greatest(m - s["j"] + max_edits, F.lit(0))  # the last row's bit, once the band has reached it
        lowest = 1 - F.shiftright(s["zero"], band - 1).bitwiseAND(1)
        along = F.call_function("shiftright", right, at).bitwiseAND(1) - F.call_function("shiftright", left, at).bitwiseAND(1)
        value = s["value"] + F.when(s["j"] <= m - max_edits, lowest).otherwise(along)
        up = left.bitwiseOR(invert(moved.bitwiseOR(right)))
        return F.struct(up.alias("up"), moved.bitwiseAND(right).alias("down"), value.alias("value"), s["j"].alias("j"))

    distance = F.aggregate(columns, begin, step, lambda s: s["value"])
    return F.when(F.abs(m - n) > max_edits, max_edits + 1).when((m == 0) | (n == 0), F.greatest(m, n)).otherwise(distance)


def _cut_ends(a: Column, b: Column) -> Column:
    """A struct of two strings without their common start, and then without their common end."""
    started = F.struct(a.alias("a"), b.alias("b"), common_start(a, b).alias("same"))
    rest = _with(started, lambda s: F.struct(*[F.substring(s[c], s["same"] + 1, F.length(s[c])).alias(c) for c in "ab"]))
    turned = _with(rest, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.reverse(s["a"]).alias("ra"), F.reverse(s["b"]).alias("rb")))
    ended = _with(turned, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), common_start(s["ra"], s["rb"]).alias("same")))
    return _with(ended, lambda s: F.struct(*[F.substring(s[c], F.lit(1), F.length(s[c]) - s["same"]).alias(c) for c in "ab"]))


def _may_be_near(a: Column, b: Column, max_edits: int) -> Column:
    """False only if more edits are needed, for strings that differ at both ends.

    Such strings begin and end with an edit, so with two edits what lies between is the same.
    """
    if max_edits > 2:
        return F.lit(True)
    few = F.greatest(F.length(a), F.length(b)) <= max_edits
    if max_edits < 2:
        return few
    edit = ((1, 1), (0, 1), (1, 0))  # letters of a and of b that an edit takes up
    for start_a, start_b in edit:
        for end_a, end_b in edit:
            n, m = F.length(a) - start_a - end_a, F.length(b) - start_b - end_b
            few = few | ((n == m) & (F.substring(a, F.lit(1 + start_a), n) == F.substring(b, F.lit(1 + start_b), m)))
    return few


def within(a: Column, b: Column, max_edits: int) -> Column:
    """Whether the edit distance of two strings is ``max_edits`` or less."""
    return _with(_cut_ends(a, b), lambda s: _may_be_near(s["a"], s["b"], max_edits) & (banded_distance(s["a"], s["b"], max_edits) <= max_edits))


def line_links(docs: DataFrame, places: DataFrame, max_edits: int = MAX_EDITS, chars_of_edit: int = CHARS_OF_EDIT) -> DataFrame:
    """(a, b): the keys (h1, h2) of all pairs of different lines that are linked, a < b; ``places`` has the lines' keys and copies."""
    if chars_of_edit < 3:
        raise ValueError("chars_of_edit: 3 at least, so that no segment of a linked line is empty")
    least_chars = chars_of_edit - 1
    once, several = single_lines(docs, places, least_chars)
    keys = segment_keys(once.unionByName(durable(several)), max_edits, chars_of_edit)
    index, probes = keys.alias("i"), keys.alias("p")  # the same rows, so that they move once
    used = (F.col("i.use") * 3 + F.col("p.use")).isin([3 * i + p for i in (INDEX, BOTH) for p in (BOTH, PROBE)])
    alike = F.bit_count(F.col("i.letters").bitwiseXOR(F.col("p.letters"))) <= BITS_OF_EDIT * max_edits
    met = index.join(probes, (F.col("i.segment") == F.col("p.segment")) & used & (F.col("i.h1") != F.col("p.h1")) & alike)
    met = met.select(F.least("i.h1", "p.h1").alias("x"), F.greatest("i.h1", "p.h1").alias("y"))
    pairs = durable(met.distinct())
    wanted = pairs.select(F.col("x").alias("h1")).unionByName(pairs.select(F.col("y").alias("h1"))).distinct()
    some = split_lines(docs).where(F.length("line") >= least_chars).select(*_key(F.col("line")), "line")
    picked = ask_bloom(some, "h1", blocked_bloom(wanted, "h1"), "maybe").where("maybe").select("h1", "h2", "line").distinct()
    texts = durable(picked.join(wanted, "h1", "left_semi"))
    left = texts.select(F.col("h1").alias("x"), F.struct("h1", "h2").alias("a"), F.col("line").alias("a_line"))
    right = texts.select(F.col("h1").alias("y"), F.struct("h1", "h2").alias("b"), F.col("line").alias("b_line"))
    both = pairs.join(left, "x").join(right, "y")
    allowed = _allowed(F.greatest(F.length("a_line"), F.length("b_line")), max_edits, chars_of_edit)
    near = F.lit(False)
    for k in range(1, max_edits + 1):
        near = near | ((allowed == k) & within(F.col("a_line"), F.col("b_line"), k))
    return both.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def placed_lines(docs: DataFrame, max_edits: int = MAX_EDITS, chars_of_edit: int = CHARS_OF_EDIT) -> DataFrame:
    """h1, h2, place (doc_id, line_no, text_key), n_copies, n_links and class (the first place of all that is linked) of each different line."""
    places = durable(line_places(docs))
    links = durable(line_links(docs, places, max_edits, chars_of_edit))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    roots = connected_components(links).join(degree, "node")
    slim = places.select("h1", "h2", F.col("first").alias("place"), "n_copies")
    near = roots.select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), "root", "n_links")
    placed = durable(slim.join(near, ["h1", "h2"], "left"))
    first = placed.where("root is not null").groupBy("root").agg(F.min("place").alias("class"))
    linked = placed.where("root is not null").join(first, "root").select("h1", "h2", "place", "n_copies", "n_links", "class")
    alone = placed.where("root is null").select("h1", "h2", "place", "n_copies", F.lit(0).cast("long").alias("n_links"), F.col("place").alias("class"))
    return linked.unionByName(alone)


def line_classes(docs: DataFrame, max_edits: int = MAX_EDITS, chars_of_edit: int = CHARS_OF_EDIT) -> DataFrame:
    """One row per different line: its first place, copies, links, and the first place of its class."""
    found = placed_lines(docs, max_edits, chars_of_edit)
    return found.select("place.doc_id", "place.line_no", "n_copies", "n_links", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"))


def line_members(docs: DataFrame, max_edits: int = MAX_EDITS, chars_of_edit: int = CHARS_OF_EDIT) -> DataFrame:
    """One row per line of every document, copies too: its place, and the copies, links and class of its text as in ``line_classes``."""
    found = placed_lines(docs, max_edits, chars_of_edit)
    about = ("n_copies", "n_links", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"))
    single = found.where("n_copies = 1").select("place.doc_id", "place.line_no", *about)
    # only lines that may repeat move; a second key makes both sides shuffle, so that a line with very many copies can be split
    repeated = found.where("n_copies > 1").select("h1", "h2", *about, F.xxhash64("h1").alias("spare"))
    lines = split_lines(docs).select("doc_id", "line_no", *_key(F.col("line")))
    asked = ask_bloom(lines, "h1", blocked_bloom(repeated, "h1"), "maybe").where("maybe").select("doc_id", "line_no", "h1", "h2", F.xxhash64("h1").alias("spare"))
    copies = asked.join(repeated, ["h1", "h2", "spare"]).select("doc_id", "line_no", "n_copies", "n_links", "class_doc_id", "class_line_no")
    return single.unionByName(copies)


def drop_near_lines(docs: DataFrame, max_edits: int = MAX_EDITS, chars_of_edit: int = CHARS_OF_EDIT) -> DataFrame:
    """The documents, in their own columns, with only the first line of each class left in the texts."""
    first = placed_lines(docs, max_edits, chars_of_edit).where("place = class").select("place.*")
    kept = first.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("kept_lines"))  # a document's own lines
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), "kept_lines")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_key"))
    joined = rows.join(kept, F.expr("row_key = kept_key and row_id <=> kept_id"), "left")
    numbered = F.transform(F.split("row.text", "\n"), lambda line, i: F.when((line == "") | F.array_contains("kept_lines", i), line))
    text = F.array_join(F.filter(numbered, lambda line: line.isNotNull()), "\n")
    return joined.withColumn("row", F.col("row").withField("text", F.when(F.col("kept_lines").isNull() & (F.col("row.text") != ""), F.lit("")).otherwise(text))).select("row.*")
