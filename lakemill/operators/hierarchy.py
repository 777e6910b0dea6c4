"""Chains of references: river into river into sea, employee to manager."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.session import materialise


def resolve_roots(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth) for every node of a forest of `node -> parent` links.

    Every round doubles the distance each open pointer spans, so a chain of length d needs
    log2(d) joins where a level-by-level recursion needs d. Only open nodes take part and are
    written again; those that have met their root stay where they were written. The lookup side
    has one row per node, so a parent shared by a third of the nodes is a skewed probe side, which
    a broadcast or a skew join splits.

    While a chain is open, its nodes of the next power of two in depth end in each round. A round
    in which none ends has only cycles left, and is an error. A parent outside of the table ends
    its chain as its root.
    """
    given = materialise(
        links.select(
            F.col(node).alias("node"),
            F.coalesce(parent, node).alias("root"),
            F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"),
            F.col(parent).isNotNull().alias("open"),
        ),
        "roots",
    )
    rows = ["node", "root", "depth"]
    ended, moving = [given.filter("NOT open").select(*rows)], given.filter("open")
    while not moving.isEmpty():
        known = reduce(DataFrame.unionByName, ended).withColumn("open", F.lit(False))
        ahead = known.unionByName(moving).select(
            F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("depth").alias("_d"),
            F.col("open").alias("_open"),
        )
        moved = materialise(
            moving.join(ahead, F.col("root") == F.col("_n"), "left").select(
                "node",
                F.coalesce("_r", "root").alias("root"),
                (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
                F.coalesce("_open", F.lit(False)).alias("open"),
            ),
            "roots",
        )
        now = moved.filter("NOT open").select(*rows)
        if now.isEmpty():
            raise ValueError("the links hold a cycle")
        ended.append(now)
        moving = moved.filter("open")
    return reduce(DataFrame.unionByName, ended)
