"""Connected components of links that may be too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node that has a link.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label, and is written to the shared folder.
    """
    edges = saved(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).union(links.select(F.col(b), F.col(a))).filter("a <> b").distinct(), "edges"
    )
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        nearby = edges.join(labels, edges.b == labels.node).groupBy(edges.a.alias("node")).agg(F.min("component").alias("best"))
        lower = labels.join(nearby, "node").select("node", F.least("component", "best").alias("label"), F.col("component").alias("old"))
        roots = labels.select(F.col("node").alias("label"), F.col("component").alias("root"))
        stepped = saved(lower.join(roots, "label").select("node", F.least("label", "root").alias("component"), "old"), "labels")
        labels = stepped.select("node", "component")
        if stepped.filter("component <> old").isEmpty():
            return labels
