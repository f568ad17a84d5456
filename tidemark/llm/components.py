"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): component is its smallest node.

    Each round gives every node the smallest label of its neighbours, then the label
    of that label.  Labels are sums of min() by node, so that a node with many links is
    combined before it is shuffled; a round's table is written, so that lost
    executors cost at most a round.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("via"))
        new = written(moved.join(jump, "to").select("node", F.least("to", "via").alias("component"), (F.least("to", "via") != F.col("was")).alias("changed")), "labels")
        labels = new.select("node", "component")
        if new.where("changed").isEmpty():
            return labels
