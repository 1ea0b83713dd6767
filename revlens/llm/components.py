"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the stored table ``edges`` (``a, b``):
    the label is the least node of its component.  Every round takes the least
    label among a node's neighbours and itself and then the label of that label;
    each round is a stored table, and it ends when nothing changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        hop = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("up"))
        jump = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        now = written(hop.join(jump, "up").select("node", F.least("up", "top").alias("label"),
                                                  (F.least("up", "top") != F.col("old")).alias("moved")), "labels")
        labels = now.select("node", "label")
        if now.where("moved").isEmpty():
            return labels
