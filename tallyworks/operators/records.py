"""Records of news pages and transcripts, in whatever shape they come, and their times.

JSON of any shape is read as a VARIANT and asked along the known paths; bad JSON is
a status, not an error. HTML pages give a record for each article, or for each
list entry that speaks of news. One row is one record, or one page that has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import strip_html
from .filing_index import plain

#: Paths of a page's records, and names of a record's fields, in their order; words of list entries that are news.
PATHS = ("items", "releases", "pressReleases", "news", "data")
FIELDS = {
    "title": ("title", "headline", "name"),
    "summary": ("summary", "description", "excerpt", "content"),
    "url": ("url", "link", "external_url", "permalink"),
    "published": ("publishedAt", "published_at", "datePublished", "date_published", "date", "pubDate"),
}
NEWS_WORDS = "press release|news release|earnings|results|announces|reports"
LEAST_TITLE = 6
#: Months, and hours that named zones are off.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
ZONES = {"gmt": "+00:00", "utc": "+00:00", "ut": "+00:00", "z": "+00:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00"}


def normalised_time(raw: Column) -> Column:
    """A struct of ts and form from a time as text: the first form that fits, null where none does.

    Forms: compact (8 or 14 digits), epoch_ms (13 digits), epoch_s (9 to 11 digits, or
    a number with decimals), date, iso (no zone: UTC) and rfc2822. A text of the
    right form whose date does not exist has no ts and no form.
    """
    value = F.trim(raw.cast("string"))
    iso = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d)(:\d\d(?:\.\d+)?)?\s*(Z|z|[+-]\d\d:?\d\d)?$"
    mail = r"(?i)^(?:[a-z]{3},\s*)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})\s+(\d\d:\d\d)(:\d\d)?\s*([a-z]{1,3}|[+-]\d{4})?$"
    part = lambda pattern, i: F.regexp_extract(value, pattern, i)
    zone = lambda z: F.when((z == "") | (F.lower(z) == "z"), "+00:00").otherwise(F.regexp_replace(z, r"^([+-]\d\d):?(\d\d)$", "$1:$2"))
    filled = lambda seconds: F.when(seconds == "", ":00").otherwise(seconds)
    month = F.lpad(F.floor((F.instr(F.lit(MONTHS), F.lower(part(mail, 2))) + 2) / 3).cast("string"), 2, "0")
    named = F.coalesce(*[F.when(F.lower(part(mail, 6)) == z, o) for z, o in ZONES.items()], zone(part(mail, 6)))
    digits = lambda a, n: F.substring(value, a, n)
    day = F.concat(digits(1, 4), F.lit("-"), digits(5, 2), F.lit("-"), digits(7, 2))
    time = F.when(F.length(value) == 14, F.concat(F.lit("T"), digits(9, 2), F.lit(":"), digits(11, 2), F.lit(":"), digits(13, 2), F.lit("+00:00"))).otherwise("T00:00:00+00:00")
    forms = (
        ("compact", r"^(\d{8}|\d{14})$", F.try_to_timestamp(F.concat(day, time))),
        ("epoch_ms", r"^\d{13}$", F.timestamp_millis(value.try_cast("long"))),
        ("epoch_s", r"^(\d{9,11}|\d{1,11}\.\d+)$", F.timestamp_micros(F.floor(value.try_cast("double") * 1e6).cast("long"))),
        ("date", r"^\d{4}-\d\d-\d\d$", F.try_to_timestamp(F.concat(value, F.lit("T00:00:00+00:00")))),
        ("iso", iso, F.try_to_timestamp(F.concat(part(iso, 1), F.lit("T"), part(iso, 2), filled(part(iso, 3)), zone(part(iso, 4))))),
        ("rfc2822", mail, F.try_to_timestamp(F.concat(part(mail, 3), F.lit("-"), month, F.lit("-"), F.lpad(part(mail, 1), 2, "0"), F.lit("T"), part(mail, 4), filled(part(mail, 5)), named))),
    )
    told = [F.when(value.rlike(pattern) & ts.isNotNull(), F.struct(ts.alias("ts"), F.lit(form).alias("form"))) for form, pattern, ts in forms]
    return F.coalesce(*told)


def joined_url(base: Column, url: Column) -> Column:
    """A link as a whole URL: absolute, ``//host``, ``/path``, ``?query``, ``#place`` or beside the page. Dot segments stay."""
    page = F.regexp_replace(base, r"[?#].*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    beside = F.when(page == origin, F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(url.isNull() | (url == ""), base)
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), url))
        .when(url.startswith("/"), F.concat(origin, url))
        .when(url.startswith("?"), F.concat(page, url))
        .when(url.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), url))
        .otherwise(F.concat(beside, url))
    )


def _got(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}" if path else "$", kind)


def _objects(values: Column) -> Column:
    return F.filter(values, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _text(record: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that has a text."""
    return F.coalesce(*[F.nullif(F.trim(_got(record, n, "string")), F.lit("")) for n in names])


def json_records(pages: DataFrame) -> DataFrame:
    """id, position, title, summary, url, published_at, time_form and status of the records of pages (id, base, body).

    Records are the first list with an object in it of items, releases, pressReleases,
    news, data, feed.items and the values of data (by key). Status: OK, NO_TITLE,
    NO_RECORDS or BAD_JSON (the last two have no position).
    """
    read = pages.select("id", "base", F.try_parse_json("body").alias("v"))
    lists = [_got(F.col("v"), p, "array<variant>") for p in (*PATHS, "feed.items")]
    of_data = F.transform(F.map_values(_got(F.col("v"), "data", "map<string,variant>")), lambda x: _got(x, "", "array<variant>"))
    every = F.concat(F.array(*lists), F.coalesce(of_data, F.array().cast("array<array<variant>>")))
    named = F.get(F.filter(F.transform(every, _objects), lambda x: F.size(x) > 0), 0)
    rows = read.select("id", "base", F.col("v").isNull().alias("bad"), F.posexplode_outer(named).alias("position", "r"))
    fields = [_text(F.col("r"), names).alias(name) for name, names in FIELDS.items()]
    told = rows.select("id", "base", "bad", "position", *fields)
    status = F.when(F.col("bad"), "BAD_JSON").when(F.col("position").isNull(), "NO_RECORDS").when(F.col("title").isNull(), "NO_TITLE").otherwise("OK")
    return _finished(told.withColumn("status", status))


def html_records(pages: DataFrame) -> DataFrame:
    """The records of HTML pages (id, base, body), in the same columns: articles, else list entries that speak of news.

    The title is the first heading, else the first link. Status: OK, NO_TITLE (under six characters) or NO_RECORDS.
    """
    articles = F.regexp_extract_all("body", F.lit(r"(?is)<article\b[^>]*>.*?</article>"), F.lit(0))
    entries = F.filter(F.regexp_extract_all("body", F.lit(r"(?is)<li\b[^>]*>.*?</li>"), F.lit(0)), lambda b: strip_html(b).rlike(f"(?i){NEWS_WORDS}"))
    blocks = F.when(F.size(articles) > 0, articles).otherwise(entries)
    rows = pages.select("id", "base", F.posexplode_outer(blocks).alias("position", "b"))
    first = lambda pattern: F.nullif(F.regexp_extract("b", pattern, 1), F.lit(""))
    title = plain(strip_html(F.coalesce(first(r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>"), first(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(""))))
    stamp = F.coalesce(first(r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']([^"']+)["']"""), strip_html(first(r"(?is)<time\b[^>]*>(.*?)</time>")))
    told = rows.select("id", "base", "position", F.when(F.length(title) >= LEAST_TITLE, title).alias("title"), plain(strip_html(F.col("b"))).alias("summary"), plain(first(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']""")).alias("url"), stamp.alias("published"))
    status = F.when(F.col("position").isNull(), "NO_RECORDS").when(F.col("title").isNull(), "NO_TITLE").otherwise("OK")
    return _finished(told.withColumn("status", status))


def _finished(told: DataFrame) -> DataFrame:
    time = normalised_time(F.col("published"))
    url = F.when(F.col("position").isNotNull(), joined_url(F.col("base"), F.col("url")))
    return told.select("id", "position", "title", "summary", url.alias("url"), time["ts"].alias("published_at"), time["form"].alias("time_form"), "status")


def transcript_paragraphs(pages: DataFrame) -> DataFrame:
    """id, position, speaker, content and status of the paragraphs of transcripts (id, body), or one row with the reason why there are none.

    Status: OK, FETCH_ERROR (no JSON object), RATE_LIMITED_OR_UNAVAILABLE (the provider left a note) or NOT_FOUND.
    """
    v = F.col("v")
    read = pages.select("id", F.try_parse_json("body").alias("v"))
    noted = _text(v, ("Note", "Information")).isNotNull()
    said = F.transform(_objects(_got(v, "transcript", "array<variant>")), lambda r: F.struct(_text(r, ("speaker", "speaker_name")).alias("speaker"), _text(r, ("content", "text")).alias("content")))
    spoken = F.filter(said, lambda p: p["content"].isNotNull())
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    rows = read.select("id", whole.alias("whole"), (whole & noted).alias("noted"), F.posexplode_outer(F.when(whole & ~noted, spoken)).alias("position", "p"))
    status = F.when(~F.col("whole"), "FETCH_ERROR").when(F.col("noted"), "RATE_LIMITED_OR_UNAVAILABLE").when(F.col("position").isNull(), "NOT_FOUND").otherwise("OK")
    return rows.select("id", "position", "p.speaker", "p.content", status.alias("status"))
