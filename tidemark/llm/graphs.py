"""Connected components of a graph given as edges, for grouping linked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, head) for edges (a, b): every node that has an edge, with the smallest node it is connected to.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so paths shrink fast.  Every
    round is written out, which cuts the lineage.  No edges give no rows.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_near")).select("node", F.least("node", "_near").alias("head"))
    labels = stored(labels, "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), "head"), "b").groupBy(F.col("a").alias("node")).agg(F.min("head").alias("_near"))
        lower = labels.join(near, "node").select("node", F.col("head").alias("_old"), F.least("head", "_near").alias("head"))
        jumped = labels.select(F.col("node").alias("head"), F.col("head").alias("_further"))
        labels = stored(lower.join(jumped, "head", "left").select("node", "_old", F.least("head", "_further").alias("head")), "labels")
        if labels.where("head != _old").isEmpty():
            return labels.drop("_old")
        labels = labels.drop("_old")
    raise RuntimeError("the components did not settle")
