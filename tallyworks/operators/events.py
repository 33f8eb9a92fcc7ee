"""News and filing events: classes, duplicate groups, coverage, search, timeline and verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The first class with a term that the lower-cased text contains.
EVENT_TERMS = (
    ("earnings", ("earnings", "eps", "quarterly", "10-q", "10-k", "annual report")),
    ("guidance", ("guidance", "outlook", "forecast", "reaffirm", "raises", "lowers")),
    ("contract", ("contract", "agreement", "deal", "partnership")),
    ("financing", ("offering", "financing", "debt", "credit facility", "note")),
    ("product", ("launch", "product", "introduce", "announces new")),
    ("analyst", ("analyst", "rating", "upgrade", "downgrade", "price target")),
    ("macro", ("macro", "inflation", "rates", "fomc", "cpi")),
    ("litigation", ("lawsuit", "litigation", "court", "settlement")),
    ("insider", ("insider", "director", "officer", "form 4")),
    ("regulatory", ("sec", "regulatory", "8-k", "10-q", "10-k", "filing")),
)
#: Words that a title's stem leaves out.
STOP_TERMS = ("yahoo", "finance", "finnhub", "globenewswire", "press", "release", "inc", "corp", "corporation", "company", "plc", "ltd", "llc")
STEM_LENGTH = 80


def event_type(text: Column) -> Column:
    plain = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(reduce(Column.__or__, (F.contains(plain, F.lit(t)) for t in terms)), name) for name, terms in EVENT_TERMS]
    return F.coalesce(*found, F.lit("other"))


def classify(news: DataFrame) -> DataFrame:
    return news.withColumn("event_type", event_type(F.col("title")))


def title_words(ticker: Column, title: Column) -> Column:
    """The title's words without links, marks, the ticker and stop terms."""
    text = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "https?://[^ \t\n\r\f]+", " ")
    words = F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & (w != F.lower(F.coalesce(ticker, F.lit("")))) & ~w.isin(*STOP_TERMS))


def title_stem(ticker: Column, title: Column) -> Column:
    return F.left(F.array_join(title_words(ticker, title), " "), F.lit(STEM_LENGTH))


def with_group(news: DataFrame) -> DataFrame:
    """The id of each item's duplicate group: a hash of stem, day and entity; null if stem and day are empty."""
    stem, day = title_stem(F.col("ticker"), F.col("title")), F.date_format("published_at", "yyyy-MM-dd")
    key = F.concat_ws("|", stem, F.coalesce(day, F.lit("")), F.upper(F.trim("ticker")))
    group = F.when((stem == "") & day.isNull(), F.lit(None)).otherwise(F.left(F.sha2(key, 256), F.lit(16)))
    return news.withColumn("group_id", group)


def keep_best(news: DataFrame) -> DataFrame:
    """The best source of each group (the lowest rank, then the latest, then the smallest id) with the others' ids."""
    best = F.struct("source_rank", -F.unix_micros(F.col("published_at").cast("timestamp")), "item_id")
    rows = with_group(news).where("group_id is not null")
    out = rows.groupBy("group_id").agg(F.min_by(F.struct("item_id", "ticker", "source", "title"), best).alias("kept"), F.sort_array(F.collect_list("item_id")).alias("ids"), F.count("*").alias("n_items"))
    others = F.array_join(F.transform(F.array_remove("ids", F.col("kept.item_id")), lambda i: i.cast("string")), ",")
    return out.select("group_id", "kept.*", "n_items", others.alias("other_ids"))


def source_coverage(news: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Items of each source by ticker, and which sources are absent."""
    out = news.groupBy("ticker").agg(*[F.count_if(F.col("source") == s).alias(f"n_{s}") for s in sources])
    missing = F.filter(F.array(*[F.when(F.col(f"n_{s}") == 0, s) for s in sources]), lambda x: x.isNotNull())
    return out.withColumn("missing", F.array_join(missing, ","))


def search(news: DataFrame, terms: list[str], start: str, end: str) -> DataFrame:
    """Items of a date window whose title contains any of the terms, each with those it contains; a null date is outside."""
    plain = F.lower(F.coalesce("title", F.lit("")))
    met = F.filter(F.array(*[F.when(F.contains(plain, F.lit(t.lower())), t) for t in terms]), lambda x: x.isNotNull())
    rows = news.where(F.to_date("published_at").between(start, end)).withColumn("terms", F.array_join(met, ","))
    return rows.where("terms <> ''").select("item_id", "ticker", "source", "title", "terms")


def timeline(news: DataFrame, limit: int = 20) -> DataFrame:
    """The newest events of each ticker with their classes."""
    newest = Window.partitionBy("ticker").orderBy(F.col("published_at").desc(), "item_id")
    rows = classify(news).withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)
    return rows.select("ticker", "position", "item_id", F.to_date("published_at").alias("day"), "event_type", "source")


#: Longs of 64 bits in a word set's mask.
MASK_PARTS = 8


def with_set(rows: DataFrame, text: str) -> DataFrame:
    """The rows that have a ticker, with the different words of a text and the id of ticker and words."""
    read = rows.where("ticker is not null").withColumn("words", F.array_sort(F.array_distinct(title_words(F.col("ticker"), F.col(text)))))
    return read.withColumn("set_id", F.unhex(F.md5(F.concat_ws("\n", "ticker", F.array_join("words", " ")))))


def _need(n: Column) -> Column:
    """How many of a claim's n words an item must have: at least two thirds, all of one or two."""
    return F.when(n <= 2, n).otherwise(F.ceil(0.67 * n)).cast("int")


def set_matches(claims: DataFrame, items: DataFrame) -> DataFrame:
    """claim_set, item_set, need and n_shared (the words shared) of the word sets (``with_set``) of which the second supports the first.

    Of n words so many must be shared that one of the claim's rarest ones is, so a claim meets
    the items with such a word only. What meets is hashes of words and masks, in which a word
    sets one bit: a claim's bits that an item lacks are no more than its words that the item
    lacks. Only sets that pass by their masks make rows, and their words are compared.
    """
    asked_sets, held_sets = (rows.groupBy("set_id").agg(F.any_value("ticker").alias("ticker"), F.any_value("words").alias("words")) for rows in (claims, items))
    keyed = lambda sets: sets.select("set_id", F.explode(F.transform("words", lambda w: F.xxhash64("ticker", w))).alias("key"))
    mask = F.array(*[F.coalesce(F.expr(f"bit_or(CASE WHEN (shiftright(key, 6) & {MASK_PARTS - 1}) = {i} THEN shiftleft(1L, CAST(key & 63 AS INT)) END)"), F.lit(0).cast("long")) for i in range(MASK_PARTS)])
    told = keyed(held_sets).groupBy(F.col("set_id").alias("item_set")).agg(mask.alias("item_mask"), F.collect_list("key").alias("keys"))  # an item's own words
    told = told.select("item_set", "item_mask", F.explode("keys").alias("item_key"))
    held = keyed(held_sets).groupBy(F.col("key").alias("held_key")).agg(F.count("*").alias("n_items"))
    asked = keyed(asked_sets).join(held, F.col("key") == F.col("held_key"), "left")
    by_rarity = F.sort_array(F.collect_list(F.struct(F.coalesce("n_items", F.lit(0)).alias("n_items"), "key")))  # a claim's own words
    rare = asked.groupBy(F.col("set_id").alias("claim_set")).agg(by_rarity.alias("by_rarity"), mask.alias("claim_mask"))
    n, need = F.size("by_rarity"), _need(F.size("by_rarity"))
    rare = rare.select("claim_set", "claim_mask", (n - need).alias("spare"), F.explode(F.slice("by_rarity", F.lit(1), n - need + 1)["key"]).alias("key"))
    lacking = " + ".join(f"bit_count(claim_mask[{i}] & ~item_mask[{i}])" for i in range(MASK_PARTS))
    met = rare.join(told, (F.col("key") == F.col("item_key")) & F.expr(f"{lacking} <= spare")).select("claim_set", "item_set").distinct()
    left = asked_sets.select(F.col("set_id").alias("claim_set"), F.col("words").alias("claim_words"))
    right = held_sets.select(F.col("set_id").alias("item_set"), "words")
    shared = met.join(left, "claim_set").join(right, "item_set").select("claim_set", "item_set", _need(F.size("claim_words")).alias("need"), F.size(F.array_intersect("claim_words", "words")).alias("n_shared"))
    return shared.where("n_shared >= need")


def claim_matches(claims: DataFrame, news: DataFrame) -> DataFrame:
    """The items that support each claim: those with at least two thirds of its words (all of one or two), each pair a row."""
    wanted = with_set(claims, "text").withColumnRenamed("set_id", "claim_set")
    items = with_set(news, "title").withColumnRenamed("set_id", "item_set")
    sets = set_matches(with_set(claims, "text"), with_set(news, "title"))
    own = wanted.select("claim_id", "claim_set", "start", "end").distinct()
    told = items.select("item_id", "item_set", "source_rank", F.to_date("published_at").alias("day"))
    return sets.join(own, "claim_set").join(told, "item_set").select("claim_id", "start", "end", "need", "item_id", "source_rank", "day", "n_shared")


def naming_items(news: DataFrame, names: DataFrame) -> DataFrame:
    """The ids of items whose title has the ticker as a word or the company's name (ticker, company; a null or empty name names nothing)."""
    title = F.lower(F.coalesce("title", F.lit("")))
    as_words = F.concat(F.lit(" "), F.regexp_replace(title, "[^a-z0-9]+", " "), F.lit(" "))
    rows = news.join(names, "ticker")
    company = F.coalesce(F.contains(title, F.lower(F.nullif("company", F.lit("")))), F.lit(False))
    return rows.where(F.contains(as_words, F.concat(F.lit(" "), F.lower("ticker"), F.lit(" "))) | company).select("item_id").distinct()


def verify(claims: DataFrame, news: DataFrame, as_of: str, conflicts: DataFrame | None = None, limited: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """What the news say of each claim (claim_id, ticker, text, start, end).

    Official support in the window confirms it, other support there confirms in part,
    support of over 90 days ago only is stale. With ``conflicts`` (group_id, groups whose
    reports disagree) a claim that one of their items supports is conflicting; with
    ``limited`` (ticker) what is not found there may only be out of reach; with ``names``
    (ticker, company) a claim is confirmed in part only if none of its official items in
    the window names the ticker or its company.
    """
    items = news
    if conflicts is not None:
        items = with_group(items).join(conflicts.select("group_id", F.lit(True).alias("disputed")).distinct(), "group_id", "left")
    if names is not None:
        items = items.join(naming_items(news, names).withColumn("naming", F.lit(True)), "item_id", "left")
    official = F.col("source_rank") == 0
    counts = {"official": official, "in_window": F.lit(True), "support": F.lit(True)}
    if conflicts is not None:
        counts["conflicts"] = F.col("disputed")
    if names is not None:
        counts["naming"] = official & F.col("naming")
    # items of one word set and day count as one row, and so do claims of one word set and window
    told = with_set(items, "title")
    daily = told.groupBy(F.col("set_id").alias("item_set"), F.to_date("published_at").alias("day")).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    wanted = with_set(claims, "text").select("claim_id", F.col("set_id").alias("claim_set"), "start", "end").distinct()
    inside = F.col("day").between(F.col("start"), F.col("end"))
    old = F.col("day") < F.date_sub(F.lit(as_of).cast("date"), 90)
    counted = {name: F.when(inside, F.col(name)).otherwise(0) if name in ("official", "in_window", "naming") else F.col(name) for name in counts}
    counted["old"] = F.when(old, F.col("support")).otherwise(0)
    windows = wanted.select("claim_set", "start", "end").distinct()
    met = set_matches(with_set(claims, "text"), told).select("claim_set", "item_set").join(windows, "claim_set").join(daily, "item_set")
    of_window = met.groupBy("claim_set", "start", "end").agg(*[F.sum(c).alias(name) for name, c in counted.items()])
    same = F.expr("w.claim_set = c.claim_set and w.start <=> c.start and w.end <=> c.end")
    found = wanted.alias("c").join(of_window.alias("w"), same).groupBy("claim_id").agg(*[F.sum(name).alias(name) for name in counted])
    every = claims.select("claim_id").distinct().join(found, "claim_id", "left")
    out = every.select("claim_id", *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("official", "in_window", "support", "old", "conflicts", "naming") if name in counted])
    confirmed = (F.col("official") > 0) & (F.col("naming") > 0) if names is not None else F.col("official") > 0
    status = F.when(confirmed, "CONFIRMED").when(F.col("in_window") > 0, "PARTIAL").when((F.col("support") > 0) & (F.col("support") == F.col("old")), "STALE").otherwise("NOT_FOUND")
    if conflicts is not None:
        status = F.when(F.col("conflicts") > 0, "CONFLICTING").otherwise(status)
    out = out.withColumn("status", status)
    if limited is not None:
        out_of_reach = claims.join(limited, "ticker", "left_semi").select("claim_id", F.lit(True).alias("limited")).distinct()
        cut = F.col("limited") & (F.col("status") == "NOT_FOUND")
        out = out.join(out_of_reach, "claim_id", "left").withColumn("status", F.when(cut, "SOURCE_LIMITED_NOT_FOUND").otherwise(F.col("status"))).drop("limited")
    return out


def title_overlap(news: DataFrame) -> DataFrame:
    """Jaccard overlap of the titles' words of consecutive items of a ticker."""
    words = F.array_distinct(title_words(F.col("ticker"), F.col("title")))
    rows = news.withColumn("words", words)
    w = Window.partitionBy("ticker").orderBy("published_at", "item_id")
    pairs = rows.withColumn("before_id", F.lag("item_id").over(w)).withColumn("before", F.lag("words").over(w)).where("before_id is not null")
    both, either = F.size(F.array_intersect("words", "before")), F.size(F.array_union("words", "before"))
    return pairs.select("item_id", "before_id", F.try_divide(both, either).alias("jaccard"))


def mentions_ticker(text: Column, ticker: str, exchanges: tuple[str, ...]) -> Column:
    """Whether a ticker stands as a word, but not behind another exchange's prefix."""
    allowed = "|".join(exchanges)
    own = text.rlike(rf"(?<![A-Za-z0-9:.-])\Q{ticker}\E(?![A-Za-z0-9-])")
    return own | text.rlike(rf"(?<![A-Za-z])(?:{allowed}): ?\Q{ticker}\E(?![A-Za-z0-9-])")
