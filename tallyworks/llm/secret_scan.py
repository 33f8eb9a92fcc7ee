"""Secret scans: fixed patterns, and two character Markov models of what they leave.

One model gives the probability of each character after another in random
strings, one in ordinary identifiers; both are trained from labelled samples. The
random ones are made by hashing, in the alphabets and lengths that keys have; the
identifiers are made from words that stand in several documents, so that no secret is
among them. A token is reported if the log-likelihood ratio favours the random
model clearly; nothing else decides but that a token has LEAST_TOKEN characters.

Positions come from the stretches between matches: a pattern that starts where
the last match ended (``\\G``) returns each gap and each match, and their lengths
add up to offsets in code points, block by block.

Results by case: a null or empty text has no spans. Rows that repeat give equal
results, and a null doc_id stays null. A table without words that repeat has no
model of identifiers, and then no token is reported. An empty table gives no rows.
Only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind, pattern, the group that is measured (0: all), its least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: What a text must contain for a pattern to be tried at all.
HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASS = r"[A-Za-z0-9+/_=-]"
LEAST_TOKEN = 12
#: Nats by which the random model must be ahead, in all and for each character.
LEAST_RATIO = 12.0
LEAST_MEAN = 0.4
#: What a pair of characters counts before it is seen.
UNSEEN = 0.05
#: Bounds of the training samples: strings of each label, and documents that words are taken from.
SAMPLE_STRINGS = 4000
SAMPLE_DOCUMENTS = 1000
#: The random samples' alphabets and lengths.
UPPER, LOWER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
RANDOM_ALPHABETS = (UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "-_", LOWER + DIGITS, UPPER + "234567", LOWER, UPPER + LOWER, DIGITS + "abcdef")
RANDOM_LENGTHS = (12, 48)


def random_strings(spark: SparkSession) -> DataFrame:
    """token: strings of hashed characters, so the same in every run."""
    alphabet = F.get(F.array(*[F.lit(a) for a in RANDOM_ALPHABETS]), (F.col("id") % len(RANDOM_ALPHABETS)).cast("int"))
    low, high = RANDOM_LENGTHS
    size = F.lit(low) + F.pmod(F.xxhash64(F.lit("length"), "id"), F.lit(high - low + 1)).cast("int")
    made = spark.range(SAMPLE_STRINGS).select("id", alphabet.alias("letters"), size.alias("n"))

    def letter(j: Column) -> Column:
        return F.substring("letters", F.pmod(F.xxhash64(F.lit("letter"), "id", j), F.length("letters")).cast("int") + 1, F.lit(1))

    return made.select(F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), letter), "").alias("token"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """token and random (0 or 1): random strings made by hashing, and identifiers made from words of several documents."""
    random = random_strings(docs.sparkSession).select("token", F.lit(1).alias("random"))
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # SAMPLE_DOCUMENTS ids
    words = some.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)))).alias("w"))
    words = words.groupBy("w").count().where("count > 1").orderBy(F.xxhash64("w"), "w").limit(SAMPLE_STRINGS).select("w")
    lower = F.lower("w")
    year = F.concat(lower, F.lit("_"), F.pmod(F.xxhash64("w"), F.lit(2100)).cast("string"))
    forms = F.array("w", lower, F.concat(lower, F.lit("_"), lower), F.concat(lower, F.initcap("w")), F.concat(F.initcap("w"), F.initcap("w")), F.concat(lower, F.lit("-"), lower, F.lit("/"), lower), F.upper("w"), year)
    plain = words.select(F.explode(forms).alias("token"), F.lit(0).alias("random"))
    return random.unionByName(plain)


def _places(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def ratio_table(samples: DataFrame) -> list[float]:
    """log P(b after a | random) - log P(b after a | identifier) for each pair, in row order."""
    n = len(ALPHABET) + 1
    places = samples.select("random", _places(F.col("token")).alias("p"))
    pairs = places.select("random", F.explode(F.zip_with(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: a * n + b)).alias("pair"))
    counts = [[UNSEEN] * (n * n), [UNSEEN] * (n * n)]
    for r in pairs.groupBy("random", "pair").count().collect():  # at most two rows a pair of letters
        counts[r["random"]][r["pair"]] += r["count"]
    if max(counts[0]) == UNSEEN:
        return [0.0] * (n * n)
    sums = [[sum(c[a * n : (a + 1) * n]) for a in range(n)] for c in counts]
    return [math.log(counts[1][i] / sums[1][i // n]) - math.log(counts[0][i] / sums[0][i // n]) for i in range(n * n)]


def token_ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token, random against ordinary."""
    n = len(ALPHABET) + 1
    ratios = F.array(*[F.lit(x) for x in table])
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))

    def step(state: Column, place: Column) -> Column:
        gain = F.when(state["before"] > 0, F.get(ratios, state["before"] * n + place)).otherwise(0.0)
        return F.struct(place.alias("before"), (state["sum"] + gain).alias("sum"))

    return F.aggregate(_places(token), start, step, lambda s: s["sum"])


SPANS = "array<struct<start:int,end:int,rank:int,kind:string,token:string>>"
#: Matches whose offsets are added up in one fold.
BLOCK = 256


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """An array of (start, end, rank, kind, token) of a pattern's leftmost matches that don't overlap."""
    rank = [k for k, *_ in BASE].index(kind) if kind in [k for k, *_ in BASE] else len(BASE)
    full = F.lit(rf"(?s)\G(.*?)({pattern})")
    parts = F.arrays_zip(F.regexp_extract_all(text, full, F.lit(1)).alias("gap"), F.regexp_extract_all(text, full, F.lit(2)).alias("match"), F.regexp_extract_all(text, full, F.lit(2 + group)).alias("value"))
    none = F.array().cast(SPANS)

    def step(state: Column, part: Column) -> Column:
        first = state["at"] + F.length(part["gap"])
        last = first + F.length(part["match"])
        one = F.struct(first.alias("start"), last.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), part["match"].alias("token"))
        return F.struct(last.alias("at"), F.when(F.length(part["value"]) >= least, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

    def in_block(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def starts(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["match"])))
        return F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def cut(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(p, i + 1, F.lit(BLOCK)))
        return _with(blocks, lambda b: F.flatten(F.zip_with(b, starts(b), in_block)))

    return _with(parts, cut)


def _overlapped(span: Column, spans: Column) -> Column:
    """Whether one of ``spans``, which follow one another, overlaps the span: the first that ends behind its start is looked up."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    size = F.size(spans)
    before = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n <= size - k) & (F.get(spans, n + k - 1)["end"] <= span["start"]), n + k).otherwise(n))
    return _with(before, lambda n: F.coalesce(F.get(spans, n)["start"] < span["end"], F.lit(False)))


def _listed(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One row per document with its counts, the digest of its base spans and all spans."""
    table = ratio_table(labelled_samples(docs) if samples is None else samples)
    text = F.coalesce(F.col("text"), F.lit(""))
    long_token = rf"(?<!{CLASS}){CLASS}{{{LEAST_TOKEN},}}+"
    none, kinds = F.array().cast(SPANS), [k for k, *_ in BASE]
    read = docs.select("doc_id", text.alias("text"))
    for kind, pattern, group, least in BASE:
        read = read.withColumn(kind, F.when(F.col("text").rlike(HINTS[kind]), _spans(F.col("text"), kind, pattern, group, least)).otherwise(none))

    def random(token: Column) -> Column:
        return token_ratio(token, table) >= F.greatest(F.lit(LEAST_RATIO), LEAST_MEAN * F.length(token))

    def apart(span: Column) -> Column:
        return ~(_overlapped(span, F.col(kinds[0])) | _overlapped(span, F.col(kinds[1])) | _overlapped(span, F.col(kinds[2])))

    # most texts have no such token, and then no place is looked for
    hint = F.exists(F.regexp_extract_all("text", F.lit(long_token), F.lit(0)), random)
    told = F.filter(_spans(F.col("text"), "markov", long_token, 0, LEAST_TOKEN), lambda s: random(s["token"]) & apart(s))
    read = read.withColumn("markov", F.when(hint, told).otherwise(none)).drop("text")

    def order(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))

    base = F.concat(*kinds)
    return read.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_listed(order(base)), 256).alias("base_sha256"),
        _listed(order(F.concat(base, F.col("markov")))).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )
