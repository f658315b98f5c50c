"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.session import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for the nodes of ``edges``.

    Columns ``a`` and ``b`` of the edges are nodes. Each round takes the smallest label among the
    neighbours, then the label of the label, so a path of length n needs about log n rounds. Every
    round is a table in the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a != b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("a"), F.min("b")).alias("label")
    )
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select(
            "node", "label", F.least("label", "near").alias("low")
        )
        of = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        stepped = lower.join(of, "low", "left").select(
            "node",
            F.least("low", F.coalesce("far", "low")).alias("label"),
            (F.least("low", F.coalesce("far", "low")) != F.col("label")).alias("moved"),
        )
        stepped = written(stepped, "labels")
        labels = stepped.select("node", "label")
        if stepped.where("moved").isEmpty():
            return labels
