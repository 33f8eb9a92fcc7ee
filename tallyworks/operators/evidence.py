"""Evidence about companies: classes of sources, policies, registries, warnings and the choice of filings and facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of sources by what they prove, and classes of events that need an official release.
FILED = ("sec_filing", "sec_ex99_found")
OWN_PAGE, OWN_FEED = "company_ir_page", "company_ir"
WIRE = ("newswire", "press_release", "yahoo_finance_press_releases")
NEWS = ("yahoo_finance_news", "company_news")
PROVIDER_HOSTS = ("finance.yahoo.com", "finnhub.io")
CHECKED_EVENTS = ("earnings", "guidance", "contract", "financing", "product", "regulatory", "litigation")
FORM_EVENTS = {"10-Q": "earnings", "10-K": "earnings", "S-3": "financing", "S-1": "financing", "424B": "financing", "8-K": "regulatory", "DEF14A": "regulatory", "PRE14A": "regulatory", "4": "insider"}
FACT_FORMS = ("10-K", "20-F", "40-F", "10-Q", "6-K", "8-K")


def event_type_of_form(form: Column) -> Column:
    kind = F.upper(F.coalesce(form, F.lit("")))
    return F.coalesce(*[F.when(kind == f, event) for f, event in FORM_EVENTS.items()], F.lit("other"))


def evidence_class(source: Column) -> Column:
    return F.when(source.isin(*FILED), "SEC_FILING").when(source == OWN_PAGE, "APPROVED_IR_PAGE").when(source == OWN_FEED, "OFFICIAL_RSS_ATOM").when(source.isin(*WIRE), "WIRE_RELEASE").otherwise("CONTEXTUAL_NEWS")


def url_provenance(source: Column, url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    provider = reduce(Column.__or__, (F.endswith(host, F.lit(h)) for h in PROVIDER_HOSTS))
    official = F.coalesce(source.isin(*FILED, OWN_PAGE, OWN_FEED), F.lit(False))
    return F.when(official, "OFFICIAL").when(F.coalesce(url, F.lit("")) == "", "UNKNOWN").when(provider, "PROVIDER").otherwise("PUBLISHER")


def decision_use(source: Column, approved: Column, event: Column) -> Column:
    use = F.when((source == "sec_ex99_found") | ((source == OWN_PAGE) & approved), "USE_OFFICIAL_EVIDENCE")
    return use.when(source.isin("sec_filing", OWN_FEED, OWN_PAGE, *WIRE) | (source.isin(*NEWS) & event.isin(*CHECKED_EVENTS)), "CHECK_OFFICIAL_RELEASES").otherwise("CONTEXT_ONLY")


def eligible(rows: DataFrame, barred: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Rows whose ticker is neither listed in ``barred`` (ticker) nor ends with a barred suffix, in any case of letters."""
    upper = F.upper("ticker")
    fits = ~F.exists(F.array(*[F.lit(s.upper()) for s in suffixes]), lambda s: F.endswith(upper, s))
    return rows.where(fits).join(barred.select(F.upper("ticker").alias("barred")), upper == F.col("barred"), "left_anti")


def with_form(tickers: DataFrame, filings: DataFrame, form: str) -> DataFrame:
    """The tickers that ever filed a form."""
    return tickers.join(filings.where(F.upper("form") == form.upper()), "ticker", "left_semi")


def with_entry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with the first entry (ticker, position, page) of their ticker in a registry; null if there is none."""
    first = registry.groupBy(F.upper("ticker").alias("entry")).agg(F.min_by("page", F.struct("position", "page")).alias("page"))
    return rows.join(first, F.upper("ticker") == F.col("entry"), "left").drop("entry")


def with_transaction(filings: DataFrame, transactions: DataFrame) -> DataFrame:
    """Insider filings (form 4) with what was parsed of each (filing_id, shares), and a warning where nothing was."""
    out = filings.where(F.upper("form") == "4").join(transactions, "filing_id", "left")
    return out.withColumn("warning", F.when(F.col("shares").isNull(), "FORM4_PARSE_UNAVAILABLE"))


def nth_filing(filings: DataFrame, n: int) -> DataFrame:
    """Each ticker's filing number n (from 0, newest first) of each form."""
    newest = Window.partitionBy("ticker", F.upper("form")).orderBy(F.desc("filing_date"), F.desc("filing_id"))
    return filings.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") == n + 1).drop("rn")


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """One row for each code and message, with the first place it was met at."""
    return warnings.groupBy("code", "message").agg(F.min("position").alias("position"))


def invalid_names(asked: Column, valid: tuple[str, ...]) -> Column:
    """The names asked for that do not exist, once each, in the order asked."""
    return F.array_except(asked, F.array(*[F.lit(v) for v in valid]))


def capped(asked: Column, cap: int) -> tuple[Column, Column]:
    """What a request of a batch is given, and what the cap leaves out and reports."""
    return F.slice(asked, 1, cap), F.slice(asked, cap + 1, F.greatest(F.size(asked) - cap, F.lit(0)))


def choose_fact(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """For each request (request_id, ticker, accn, form, topic) the fact (ticker, accn, form, concept, label, end, filed, value) that answers it.

    A fact fits if its form is one of the periodic ones, its filing and form are the
    request's where both are known, and its words hold the topic. If none fits, any
    fact of the ticker will do unless a topic is asked for. The latest wins, then the
    largest, then the first label. A fact without a value never answers.
    """
    compact = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    f = facts.where("value is not null").select("ticker", *[F.col(c).alias(f"fact_{c}") for c in ("accn", "form", "concept", "label", "end", "filed", "value")])
    same = lambda c: F.coalesce(F.col(c) == F.col(f"fact_{c}"), F.lit(True))
    on_topic = F.col("topic").isNull() | F.contains(compact(F.concat_ws(" ", "fact_concept", "fact_label")), compact(F.col("topic")))
    fits = F.coalesce(F.col("fact_form").isin(*FACT_FORMS), F.lit(False)) & same("accn") & same("form") & on_topic
    met = requests.join(f, "ticker").withColumn("fits", fits).where(F.col("fits") | F.col("topic").isNull())
    best = F.struct(~F.col("fits"), -F.unix_date(F.coalesce("fact_end", "fact_filed")), -F.abs("fact_value"), "fact_label")
    found = met.groupBy("request_id").agg(F.min_by(F.struct("fact_concept", "fact_label", "fact_end", "fact_value", "fits"), best).alias("fact"))
    return requests.join(found, "request_id", "left").select("request_id", "ticker", "topic", F.col("fact.fact_concept").alias("concept"), F.col("fact.fact_label").alias("label"), F.col("fact.fact_end").alias("end"), F.col("fact.fact_value").alias("value"), F.col("fact.fits").alias("fits"))
