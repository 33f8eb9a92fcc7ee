"""URL filters: host and path rules, and a blocked Bloom filter of listed URLs before an exact join.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest rule that fits decides. A page without a rule is blocked if its canonical
URL is listed. The Bloom filter, whose size is bounded, lets possible hits pass to an
exact hash join that removes false positives; all other pages never move.

The canonical URL is the host without a leading ``www.``, the path without a
closing ``/`` or ``.html``, and the sorted query fields but those of tracking;
scheme and fragment are dropped.

Results by case: a null URL, or one without ``://``, has an empty host and path
and is allowed. Pages that repeat get one row each with equal verdicts, and
URLs listed more than once count once. Null listed URLs are ignored. Other
columns than page_id and url are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import ask_bloom, blocked_bloom

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Sites whose pages make up the list of the query.
LISTED_SITES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """The canonical form; null for a null URL or one without ``://``."""
    host = F.regexp_replace(host_of(url), "^www[.]", "")
    path = F.regexp_replace(path_of(url), "(/|[.]html)$", "")
    fields = F.split(F.regexp_extract(url, "://[^?#]*[?]([^#]*)", 1), "&")
    query = F.array_join(F.array_sort(F.filter(fields, lambda f: (f != "") & ~f.startswith("utm_") & ~f.startswith("ref="))), "&")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct of the longest fitting rule and its verdict, or null."""
    longest = sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)
    cases = (F.when(_fits(host, path, h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest)
    return F.coalesce(*cases)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page; ``listed`` has a column url."""
    urls = listed.select(canonical_url(F.col("url")).alias("listed_url")).where("listed_url is not null").distinct()
    urls = urls.withColumn("listed_key", F.xxhash64("listed_url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), canonical_url(F.col("url")).alias("canonical"))
    judged = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("url_key", F.xxhash64("canonical"))
    asked = ask_bloom(judged, "url_key", blocked_bloom(urls, "listed_key"), "maybe")
    possible = F.col("maybe") & F.col("fit").isNull() & F.col("canonical").isNotNull()
    shown = ["page_id", "host", "path", F.col("fit.rule").alias("rule")]
    clear = asked.where(~possible).select(*shown, F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"))
    # the key besides the URL makes both sides shuffle, so that a very frequent URL can be split
    exact = (F.col("canonical") == F.col("listed_url")) & (F.col("url_key") == F.col("listed_key"))
    met = asked.where(possible).join(urls, exact, "left")
    hits = met.select(*shown, F.when(F.col("listed_url").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return clear.unionByName(hits)


def listed_pages(pages: DataFrame, sites=LISTED_SITES) -> DataFrame:
    """The list of the query: of the URLs on the given sites those that a hash chooses, about half, each with another scheme and a tracking field."""
    on_site = reduce(Column.__or__, (F.contains(F.concat(F.lit("."), host_of(F.col("url"))), F.lit(f".{s}.")) for s in sites))
    chosen = F.substring(F.md5(F.col("url")), 1, 1) < "8"
    own = F.regexp_replace(F.regexp_replace("url", "^[^:]*://", "ftp://"), "#.*$", "")
    return pages.where(on_site & chosen).select(F.concat(own, F.when(F.contains(own, F.lit("?")), "&").otherwise("?"), F.lit("utm_source=list")).alias("url"))


_SITES = " OR ".join(f"contains('.' || host, '.{s}.')" for s in LISTED_SITES)
_FITS = {(v, h, p): f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for v, h, p in RULES}
_ORDER = sorted(RULES, key=lambda r: len(r[1] + r[2]), reverse=True)
URL_SQL = rf"""
WITH parts AS (
    SELECT page_id, url,
           translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
           list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*[?]([^#]*)', 1), '&'),
                     lambda f: f <> '' AND NOT starts_with(f, 'utm_') AND NOT starts_with(f, 'ref='))) AS fields
    FROM pages),
forms AS (
    SELECT *, CASE WHEN contains(url, '://') THEN
               regexp_replace(host, '^www[.]', '') || regexp_replace(path, '(/|[.]html)$', '')
               || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS canonical
    FROM parts),
listed AS (SELECT DISTINCT canonical AS listed_url FROM forms WHERE canonical IS NOT NULL AND substring(md5(url), 1, 1) < '8' AND ({_SITES})),
ruled AS (
    SELECT *, CASE {" ".join(f"WHEN {_FITS[r]} THEN '{r[1]}{r[2]}'" for r in _ORDER)} END AS rule,
              CASE {" ".join(f"WHEN {_FITS[r]} THEN '{r[0]}'" for r in _ORDER)} END AS ruling
    FROM forms)
SELECT page_id, host, path, rule,
       coalesce(ruling, CASE WHEN listed_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN listed ON canonical = listed_url
"""
