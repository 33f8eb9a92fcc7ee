"""Company profiles, screening, identity and filings' exhibits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ladders import ladder


def select_fields(profiles: DataFrame, fields: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """The key and the named fields; a group's name stands for its fields, and each field comes once."""
    wanted = [f for name in fields for f in groups.get(name, [name])]
    known = [f for f in dict.fromkeys(wanted) if f in profiles.columns]
    return profiles.select("ticker", *known)


def without_fund_fields(profiles: DataFrame, fund_fields: list[str]) -> DataFrame:
    """Fields of funds and crypto-currencies are null for equities."""
    return profiles.withColumns({f: F.when(F.col("quote_type") != "EQUITY", F.col(f)) for f in fund_fields})


def short_momentum(shorts: DataFrame) -> DataFrame:
    """Month-on-month change of short interest, its direction, and the squeeze class."""
    pct = F.col("short_pct_float") * 100
    change = F.try_divide(F.col("shares_short") - F.col("shares_short_prior"), F.nullif(F.col("shares_short_prior"), F.lit(0))) * 100
    direction = F.when(F.abs(change) < 2, "FLAT").when(change > 0, "RISING").when(change.isNotNull(), "FALLING")
    squeeze = F.when((pct > 30) & (F.col("short_ratio") < 3), "HIGH").when(pct > 20, "MODERATE").when(pct.isNotNull(), "LOW")
    flag = ladder(pct, [(">", 30, "CRITICAL"), (">", 20, "HIGH")], None)
    return shorts.select("ticker", pct.alias("short_pct"), change.alias("mom_change_pct"), direction.alias("mom_direction"), squeeze.alias("squeeze_risk"), flag.alias("flag"))


#: Screens by name: the condition and the order.
SCREENS = {
    "large": ("market_cap >= 5000", ("market_cap", False)),
    "losers": ("change_pct < 0", ("change_pct", True)),
    "gainers": ("change_pct > 0", ("change_pct", False)),
}


def screen(quotes: DataFrame, name: str, count: int = 25) -> DataFrame:
    """The first rows of a named screen, with ties in order of the ticker."""
    condition, (key, ascending) = SCREENS[name]
    order = F.col(key).asc_nulls_last() if ascending else F.col(key).desc_nulls_last()
    return quotes.where(condition).orderBy(order, "ticker").limit(min(count, 250))


LEGAL_SUFFIXES = ("inc", "corp", "corporation", "company", "co", "plc", "ltd", "llc", "group", "holdings", "sa", "ag", "nv")
SMALL_WORDS = ("and", "of", "the", "for")


def phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def identities(names: DataFrame) -> DataFrame:
    """ticker, aliases (the full name, and that without legal suffixes) and acronym of each company (ticker, name)."""
    full = phrase(F.col("name"))
    short = F.trim(F.regexp_replace(full, rf"( (?:{'|'.join(LEGAL_SUFFIXES)}))+$", ""))
    words = F.filter(F.split(short, " "), lambda w: (w != "") & ~w.isin(*SMALL_WORDS))
    letters = F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")
    aliases = F.array_distinct(F.filter(F.array(full, short), lambda a: F.length(a) >= 3))
    return names.select("ticker", aliases.alias("aliases"), F.when(F.length(letters).between(3, 6), letters).alias("acronym"))


def match_issuer(news: DataFrame, names: DataFrame) -> DataFrame:
    """How an item's title names its ticker's company: as the ticker, by name, or by acronym."""
    rows = news.join(identities(names), "ticker", "left")
    plain = F.concat(F.lit(" "), phrase(F.col("title")), F.lit(" "))
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    token = F.contains(padded(F.regexp_replace("title", "[^A-Za-z0-9]+", " ")), padded(F.upper("ticker")))
    by_name = F.exists("aliases", lambda a: F.contains(plain, padded(a)))
    match = F.when(token, "TICKER_TOKEN").when(by_name, "ISSUER_NAME").when(F.contains(plain, padded(F.col("acronym"))), "ISSUER_ACRONYM")
    return rows.select("item_id", "ticker", "title", match.alias("match"))


def has_category(categories: Column, ticker: Column) -> Column:
    """Whether a comma-separated list of ``exchange:symbol`` names a ticker."""
    symbols = F.transform(F.split(F.coalesce(categories, F.lit("")), ","), lambda c: F.upper(F.trim(F.substring_index(c, ":", -1))))
    return F.array_contains(symbols, F.upper(ticker))


def resolve_cik(requests: DataFrame, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first answer of several maps (ticker, cik), with the map that gave it."""
    out, answers = requests, []
    for name, table in steps:
        out = out.join(table.select("ticker", F.col("cik").alias(f"cik_{name}")), "ticker", "left")
        answers.append((name, F.col(f"cik_{name}")))
    source = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in answers], F.lit("NOT_FOUND"))
    return out.select("ticker", F.coalesce(*[c for _, c in answers]).alias("cik"), source.alias("source"))


def with_exhibit(filings: DataFrame, exhibits: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Each filing with its first exhibit of the given kinds, the kinds in order of preference."""
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("exhibit_type"))
    best = Window.partitionBy("filing_id").orderBy("place", "sequence")
    first = exhibits.where(F.col("exhibit_type").isin(*kinds)).withColumn("place", place).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return filings.join(first.select("filing_id", "exhibit_type", "sequence"), "filing_id", "left")
