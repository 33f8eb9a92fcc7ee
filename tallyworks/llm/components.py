"""Connected components by alternating stars, with checkpoints between the rounds.

In a large-star round every node hands its larger neighbours to the smallest
one that it knows, in a small-star round its smaller ones. Both keep the
components; when neither changes a link, each node points at the smallest of
its component. All work is grouping and joining of links; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _to_smallest(directed: DataFrame) -> DataFrame:
    """For (node, other): each other, and the node itself, linked to the smallest of them all."""
    least = directed.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
    # a second key makes both sides shuffle, so that a node with very many links can be split
    spare = F.xxhash64("node").alias("spare")
    handed = directed.select("*", spare).join(least.select("*", spare), ["node", "spare"])
    return handed.select(F.col("other").alias("big"), F.col("least").alias("small")).unionByName(least.select(F.col("node").alias("big"), F.col("least").alias("small")))


def _links(links: DataFrame) -> DataFrame:
    return links.where("big <> small").select(F.greatest("big", "small").alias("big"), F.least("big", "small").alias("small")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for all nodes of the links (a, b)."""
    now = durable(links.select(F.col("a").alias("big"), F.col("b").alias("small")).transform(_links))
    mark = None
    while True:
        both = now.select(F.col("big").alias("node"), F.col("small").alias("other")).unionByName(now.select(F.col("small").alias("node"), F.col("big").alias("other")))
        large = _to_smallest(both).where("big > small").transform(_links)
        down = large.select(F.col("big").alias("node"), F.col("small").alias("other"))
        now = durable(_to_smallest(down).transform(_links))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("small").alias("root")).distinct()
    return now.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(roots.select(F.col("root").alias("node"), "root"))
