"""Groups of linked ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``links`` (a, b): the least node reachable. In each round a node
    takes the least root among its neighbours' and then its root's root, so rounds grow with the
    logarithm of a group's width; each is checkpointed. Needs a checkpoint folder."""
    both = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = links.where("a <> b").select(both).distinct().checkpoint()
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")).checkpoint()
    for _ in range(rounds):
        near = edges.join(roots, edges["b"] == roots["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", F.least("root", "near").alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = lower.join(jump, "root").select("node", F.least("root", "up").alias("root")).checkpoint()
        changed = new.withColumnRenamed("root", "new").join(roots, "node").where("new <> root").limit(1).count()
        roots = new
        if not changed:
            return roots
    raise RuntimeError(f"groups are not complete after {rounds} rounds")
