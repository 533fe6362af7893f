"""Connected components of a link table, with all state in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b): label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    labels travel over twice the distance in every round. A round is checkpointed, so lost
    executors cost one round at most. Joins on a hot label are split by Spark's skew handling:
    one side of each is unique.
    """
    links = cut(links.select("a", "b").filter("a <> b"))
    both = cut(links.union(links.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = cut(labels.select("node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = step.join(jump, "via").select("node", "old", F.least("via", "far").alias("label"))
        moved = cut(moved)
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels
