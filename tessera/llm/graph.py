"""Connected components over an edge table, by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours (summed up before the shuffle, so a hub is
    no hot task), then replaces labels by their own labels.  The tables joined are written between steps:
    both sides of each join then arrive by plain exchanges, which adaptive execution can split for a hub.
    Nulls and self-loops link nothing; an empty table gives an empty result.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        seen = label.select(F.col("node").alias("b"), "component")
        least = cut(both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m")))
        hooked = cut(label.join(least, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component")))
        parent = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        label = cut(hooked.join(parent, "component").select("node", "old", F.col("up").alias("component")))
        if label.where("old <> component").isEmpty():
            return label.select("node", "component")
