"""Connected components of an edge table by min-label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of an edge; the label is the component's smallest node.

    Each round a node takes the smallest label among itself, its neighbours
    and its label's own label, so long chains halve.  Labels are written to
    the shared folder each round; only the count of changes reaches the driver.
    Self loops and repeated edges are allowed; null ends are ignored.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = materialize(pairs.union(pairs.select("y", "x")).union(pairs.select("x", "x")).union(pairs.select("y", "y")).distinct(), "edges")
    labels = both.groupBy("x").agg(F.min("y").alias("label")).withColumnRenamed("x", "node")
    labels = materialize(labels, "labels")
    while True:
        near = (both.join(labels, both.y == labels.node).select(F.col("x").alias("node"), "label")
                .groupBy("node").agg(F.min("label").alias("near")))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = labels.join(near, "node").join(jump, "label", "left").select(
            "node", F.least("label", "near", F.coalesce("far", "label")).alias("label"),
            (F.least("near", F.coalesce("far", "label")) < F.col("label")).alias("moved"))
        step = materialize(step, "labels")
        moved = step.where("moved").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels
