"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least node it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """node, root of all nodes of ``links`` (u, v): the root is the least node reachable.

    The number of rounds grows with the logarithm of the number of nodes. Every round is
    written to the shared folder, and only its counts come to the driver. Links of a node to
    itself do not count; without links the result is empty."""
    edges = common.stored(links.where("u <> v").select("u", "v").distinct(), "links")
    parts = common.parts_for(edges.count())
    before = None
    while True:
        large = common.stored(_large_star(edges), "large", parts)
        old, edges = edges, common.stored(_small_star(large).where("u <> v").coalesce(parts).distinct(), "stars", parts)
        common.remove(old, large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
