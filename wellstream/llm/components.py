"""Connected components of links by repeated minima, with a reliable checkpoint after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellstream.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Each round takes the smallest label among the neighbours' and then the label of that label, so a path shrinks fast.
    Minima are combined before the shuffle, so a node with very many links is no burden. Null ends are left out.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("hop"))
        step = labels.join(hop, "component", "left").join(near, "node", "left")
        new = cut(step.select("node", F.least("component", "hop", "near").alias("component"), F.col("component").alias("before")))
        moved = new.where("component <> before").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
