"""Connected components of an edge table, by hooking labels to smaller neighbours and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.tables import written

JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge ``(a, b)``; the label is the least node of its component.

    In each round every label takes the least label beside it, chains of such steps are shortened by JUMPS doublings, and
    the edges shrink to those between different labels. All state lives in tables of the shared folder. An empty edge table gives no rows.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "steps")
        for _ in range(JUMPS):
            step = written(step.join(step.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left").select("a", F.coalesce("q", "p").alias("p")), "steps")
        labels = written(labels.join(step.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        moved = edges.join(step, "a").select("b", F.col("p").alias("pa")).join(step.withColumnRenamed("a", "b"), "b")
        edges = written(moved.select(F.least("pa", "p").alias("a"), F.greatest("pa", "p").alias("b")).filter("a <> b").distinct(), "edges")
    return labels
