"""Connected components of a table of edges, by smallest labels and pointer jumping on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.staging import drop_stage, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): the smallest node of its component.

    A round takes the smallest label beside each node, then the label's own label, so the rounds grow
    with the logarithm of a component's width.  Labels are staged each round: nothing is collected
    but the number of changes, and the joins' skewed keys (hubs) are split at run time.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        beside = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        )
        lower = stage(labels.join(beside, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label")), "lower")
        jumped = stage(
            lower.join(lower.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
            .select("node", "old", F.least("label", "far").alias("label")), "labels")
        changed = jumped.where("label <> old").limit(1).count()
        drop_stage(lower)
        drop_stage(labels)
        labels = jumped.select("node", "label")
        if not changed:
            drop_stage(both)
            return labels
