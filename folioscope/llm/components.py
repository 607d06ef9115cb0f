"""Connected components of a link table, by min-label steps with jumps, each step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node it reaches, for every node of `links` (a, b). Works for any cluster shape.

    Each step gives a node the smallest label among itself and its neighbours, then that label's own label, so the reach
    doubles. Minima are taken before the shuffle, so a node with many links is no hot spot.
    """
    both = kept(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        closer = labels.join(near, labels.node == near.a).select(
            "node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("next"))
        stepped = kept(closer.join(jump, F.col("component") == F.col("at")).select(
            "node", F.least("component", "next").alias("component"), (F.least("component", "next") != F.col("old")).alias("changed")))
        labels = stepped.select("node", "component")
        if stepped.where("changed").isEmpty():
            return labels
