"""Fund identities, net asset values and dividends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_nav(nav: DataFrame, start: str, end: str) -> DataFrame:
    """The newest value of each fund class within a window, the later of equal dates by sequence."""
    rows = nav.where(F.col("nav_date").between(start, end))
    return rows.groupBy("proj_id", "fund_class").agg(F.max("nav_date").alias("nav_date"), F.max_by("last_val", F.struct("nav_date", "seq")).alias("last_val"), F.count("*").alias("n_rows"))


def class_status(exact: Column, classes: Column) -> Column:
    return F.when(exact > 0, "OK").when(classes == 1, "OK_SINGLE_CLASS").when(classes > 1, "AMBIGUOUS").otherwise("UNVERIFIED_NO_ROWS")


def resolve_class(requests: DataFrame, nav: DataFrame) -> DataFrame:
    """For each (proj_id, wanted) whether the class has rows; a fund of one class answers for any name, several are ambiguous."""
    by_class = nav.groupBy("proj_id", "fund_class").agg(F.count("*").alias("n"))
    met = requests.join(by_class, "proj_id", "left")
    out = met.groupBy("proj_id", "wanted").agg(F.count_if(F.col("fund_class") == F.col("wanted")).alias("exact"), F.count_distinct("fund_class").alias("classes"), F.min("fund_class").alias("first_class"))
    status = class_status(F.col("exact"), F.col("classes"))
    used = F.when(F.col("exact") > 0, F.col("wanted")).when(F.col("classes") == 1, F.col("first_class"))
    return out.select("proj_id", "wanted", "classes", status.alias("status"), used.alias("used_class"))


def batch_nav(requests: DataFrame, nav: DataFrame) -> DataFrame:
    """Status and newest value of each request together."""
    resolved = resolve_class(requests, nav)
    last = nav.groupBy("proj_id", F.col("fund_class").alias("used_class")).agg(F.max("nav_date").alias("nav_date"), F.max_by("last_val", F.struct("nav_date", "seq")).alias("last_val"))
    return resolved.join(last, ["proj_id", "used_class"], "left").select("proj_id", "wanted", "status", "nav_date", "last_val")


def keyset_page(rows: DataFrame, after: tuple | None, keys: list[str], limit: int) -> DataFrame:
    """The rows after a key in order of the keys, as many as fit a page."""
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, after, strict=True)]))
    return rows.orderBy(*keys).limit(limit)


def search_profiles(profiles: DataFrame, term: str) -> DataFrame:
    """Profiles whose name or id contains a term, with a match class: exact, prefix or contains."""
    plain, wanted = F.lower("name"), term.lower()
    kind = F.when(plain == wanted, "exact").when(F.startswith(plain, F.lit(wanted)), "prefix").when(F.contains(plain, F.lit(wanted)), "contains")
    return profiles.withColumn("match", kind).where("match is not null")


def resolve_profile(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """One match is OK, none is not found, several are ambiguous."""
    found = requests.join(profiles, "name", "left").groupBy("name").agg(F.count("proj_id").alias("n"), F.min("proj_id").alias("proj_id"))
    status = F.when(F.col("n") == 1, "OK").when(F.col("n") == 0, "NOT_FOUND").otherwise("AMBIGUOUS")
    return found.select("name", "n", status.alias("status"), F.when(F.col("n") == 1, F.col("proj_id")).alias("proj_id"))


def dividends_since(dividends: DataFrame, rows: int) -> DataFrame:
    """The newest payments of each fund with the total and the change on the one before."""
    newest = Window.partitionBy("proj_id").orderBy(F.col("pay_date").desc(), F.col("seq").desc())
    ranked = dividends.withColumn("rn", F.row_number().over(newest)).withColumn("before", F.lead("amount").over(newest))
    return ranked.where(F.col("rn") <= rows).select("proj_id", "pay_date", "amount", "rn", F.try_divide(F.col("amount") - F.col("before"), F.abs("before")).alias("change"))
