"""Allow-lists of hosts and paths, and of content types, as joins with tables of rules.

A URL asks with its host and the parents of its host, and of its path only with
starts of such lengths as the rules of that host have; both are equal keys, so a
list of any length is one hash join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def url_parts(url: Column) -> Column:
    """scheme, host (lower case, without ``www.``, user and port) and path; all null without a scheme."""
    whole = F.trim(F.coalesce(url, F.lit("")))
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
    scheme, host, path = (F.regexp_extract(whole, pattern, i) for i in (1, 2, 3))
    return F.when(scheme != "", F.struct(F.lower(scheme).alias("scheme"), F.regexp_replace(F.lower(host), r"^www\.", "").alias("host"), path.alias("path")))


def allowed_urls(urls: DataFrame, rules: DataFrame, schemes: tuple[str, ...] = ("https",)) -> DataFrame:
    """The rows (id, url) with scheme, host, path, rule_id and status.

    Rules have rule_id, host, prefix and subdomains (whether hosts below it count
    too). The rule of the longest host, then the longest prefix, then the smallest
    rule_id counts. Status: ALLOWED, PATH (rules for the host, none for the path),
    HOST, SCHEME or MALFORMED. Rules with a null host or prefix fit nothing; rows
    that repeat an id and url give repeated results.
    """
    read = urls.select("id", "url", url_parts(F.col("url")).alias("u")).select("id", "url", "u.*")
    listed = rules.where("host is not null and prefix is not null").select("rule_id", F.regexp_replace(F.lower("host"), r"^www\.", "").alias("key"), "prefix", F.coalesce("subdomains", F.lit(False)).alias("below"))
    lengths = listed.groupBy("key", "below").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    best = listed.groupBy("key", "below", "prefix").agg(F.min("rule_id").alias("rule_id"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), F.lit(True).alias("below")))
    asked = F.concat(F.array(F.struct(F.col("host").alias("key"), F.lit(False).alias("below"))), parents)
    distinct = read.where(F.col("host") != "").select("host", "path").distinct()
    hosts = distinct.select("host", "path", F.explode(asked).alias("ask")).select("host", "path", "ask.*").join(lengths, ["key", "below"])
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    starts = hosts.select("host", "path", "key", "below", F.explode_outer(F.transform(fitting, lambda n: F.left("path", n))).alias("prefix"))
    met = starts.join(best, ["key", "below", "prefix"], "left")
    rank = F.when(F.col("rule_id").isNotNull(), F.struct(-F.length("key"), -F.length("prefix"), F.col("rule_id")))
    chosen = met.groupBy("host", "path").agg(F.min_by("rule_id", rank).alias("rule_id"))
    judged = read.join(chosen.withColumn("host_known", F.lit(True)), ["host", "path"], "left")
    scheme_fits = F.col("scheme").isin(*schemes)
    status = F.when(F.col("scheme").isNull(), "MALFORMED").when(~scheme_fits, "SCHEME").when(F.col("rule_id").isNotNull(), "ALLOWED").when(F.col("host_known"), "PATH").otherwise("HOST")
    return judged.select("id", "url", "scheme", "host", "path", F.when(scheme_fits, F.col("rule_id")).alias("rule_id"), status.alias("status"))


def content_allowed(items: DataFrame, types: DataFrame) -> DataFrame:
    """The items with ``rejected``: CONTENT_TYPE if their content_type is named and not listed in ``types`` (content_type), in any case."""
    listed = types.select(F.upper("content_type").alias("known")).where("known is not null").distinct().withColumn("listed", F.lit(True))
    kind = F.upper(F.coalesce("content_type", F.lit("")))
    read = items.join(listed, kind == F.col("known"), "left")
    return read.withColumn("rejected", F.when((kind != "") & F.col("listed").isNull(), "CONTENT_TYPE")).drop("known", "listed")
