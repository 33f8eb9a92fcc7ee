"""Totals for regional facts by ranked keys: the same filing, the same period, a filing date near by, any.

Each regional fact asks with all its keys at once, and of the totals one row a key
is kept before the join, so the work is one equi-join and never a product of a
ticker's facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCESSION, PERIOD, NEAR, ANY = range(4)
NAMES = ("accession", "period", "near date", "any")


def with_total(regional: DataFrame, totals: DataFrame, days: int = 10) -> DataFrame:
    """The regional facts with total_id, total, matched_by and ratio (four decimals; null if the total is not above zero).

    Both sides have ticker, concept, accn, end, filed and value; regional facts have
    fact_id (one row each), totals have total_id. Null keys match nothing but ANY.
    Of equal rank the nearest filing date counts, then the latest period, the latest
    filing and the smallest total_id.
    """
    keys = ["ticker", "concept"]
    week = lambda c: F.floor(F.unix_date(c) / 7)
    order = F.struct(-F.unix_date("end"), -F.unix_date("filed"), F.col("total_id"))
    row = F.struct("total_id", F.col("value").alias("total"), F.col("end").alias("total_end"), F.col("filed").alias("total_filed"))
    held = totals.select(*keys, "accn", "end", "filed", order.alias("order"), row.alias("row"))

    def best(kind: int, *by: str) -> DataFrame:
        return held.groupBy(*keys, *by).agg(F.min_by("row", "order").alias("row")).withColumn("kind", F.lit(kind))

    dated = best(NEAR, "filed")
    offered = [
        best(ACCESSION, "accn").select(*keys, "kind", F.col("accn").cast("string").alias("key"), "row"),
        best(PERIOD, "end").select(*keys, "kind", F.col("end").cast("string").alias("key"), "row"),
        dated.select(*keys, "kind", week(F.col("filed")).cast("string").alias("key"), "row"),
        best(ANY).select(*keys, "kind", F.lit("").alias("key"), "row"),
    ]
    first, last = week(F.date_sub("filed", days)), week(F.date_add("filed", days))
    asked_key = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    weeks = F.transform(F.coalesce(F.sequence(first, last), F.array().cast("array<bigint>")), lambda w: asked_key(NEAR, w))
    asks = F.concat(F.array(asked_key(ACCESSION, F.col("accn")), asked_key(PERIOD, F.col("end")), asked_key(ANY, F.lit(""))), weeks)
    asking = regional.select("fact_id", *keys, "filed", F.explode(asks).alias("ask")).select("fact_id", *keys, "filed", "ask.*")
    met = asking.join(offered[0].unionByName(offered[1]).unionByName(offered[2]).unionByName(offered[3]), [*keys, "kind", "key"])
    apart = F.abs(F.datediff("filed", "row.total_filed"))
    near = met.where((F.col("kind") != NEAR) | (apart <= days))
    rank = F.struct("kind", F.when(F.col("kind") == NEAR, apart).otherwise(0), -F.unix_date("row.total_end"), -F.unix_date("row.total_filed"), "row.total_id")
    chosen = near.groupBy("fact_id").agg(F.min_by(F.struct("kind", "row"), rank).alias("c")).select("fact_id", "c.row.total_id", "c.row.total", F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("c.kind") + 1).alias("matched_by"))
    ratio = F.when(F.col("total") > 0, F.round(F.col("value") / F.col("total"), 4))
    return regional.join(chosen, "fact_id", "left").withColumn("ratio", ratio)
