"""Connected components by spreading the smallest label and following labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of `edges` (a, b), longs.

    Each round halves the way to the smallest node at least along chains of labels; rounds end
    when no label moves. Every round is written to the shared folder, so lineage stays short.
    A node with very many edges is reduced to its smallest neighbour before the shuffle.
    """
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialise(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("_near"))
        )
        spread = labels.join(near, "node").select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("label")
        )
        spread = materialise(spread, "labels")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        moved = spread.join(jump, "label", "left").select(
            "node", "_old", F.least("label", F.coalesce("_next", "label")).alias("label")
        )
        moved = materialise(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> _old").limit(1).count() == 0:
            return labels
