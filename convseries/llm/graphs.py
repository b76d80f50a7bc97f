"""Connected components of an edge table, by the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convseries.llm.common import small_checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id in edges (a, b) the smallest id that it reaches.

    Every round takes the smallest label among the neighbours and then the label of that label, so that long chains
    halve; it ends when no label changes. Labels and edges stay in the cluster; only the number of changes is read.
    """
    both = small_checkpoint(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = small_checkpoint(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("near")), "other").groupBy("id").agg(F.min("near").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = small_checkpoint(lower.join(jump, "component", "left").select("id", "was", F.least("component", "next").alias("component")))
        labels = after.select("id", "component")
        if after.where("component != was").isEmpty():
            return labels
