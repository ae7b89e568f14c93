"""Connected components over an edge table, in rounds that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over edges (u, v).

    Each round takes the least label among a node's neighbours and then jumps to the label
    of that label, so rounds grow with the logarithm of a component's width. Every round is
    a written table. No edges give an empty table; self loops and repeats are harmless.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.*")
    both = materialise(both.distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = materialise(step, "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = materialise(step.join(jump, "label").select("node", "was", F.least("label", "far").alias("label")), "labels")
        changed = moved.agg(F.count_if(F.col("was") != F.col("label")).alias("n")).first()["n"]
        labels = moved.select("node", "label")
        if not changed:
            return labels
