"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the smallest node of its component.

    Each round takes the least label among a node and its neighbours, then
    replaces the label by that label's own label, so the number of rounds is about
    the logarithm of the longest path.  Tables stay as long as nodes and edges;
    labels are pre-aggregated before they are shuffled, and each round is cut off
    by a table in the shared folder.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).where("u <> v").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stepped.join(target, "label").select("node", "old", F.least("label", "next").alias("label"))
        after = materialise(jumped, "labels")
        discard(labels)
        if not after.where("label <> old").head(1):
            discard(both)
            return after.drop("old")
        labels = after
