"""Connected components by contraction, as joins and aggregates only.

Each round every node points to the neighbour (or itself) whose hashed id is smallest;
edges are then drawn between what their ends point to, and loops and repeats fall
away. With hashed ids the number of nodes falls by a constant factor a round, also on
paths and stars. Every round is written, so nothing is recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bolide.plans.settle import settle


def contract(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Merge labels: ``labels`` (node, label) after joining the labels that ``edges`` (a, b) link.

    ``edges`` are between labels. Both are tables of longs; nulls are not allowed.
    """
    edges = settle(edges.filter("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        points = settle(
            both.groupBy("a")
            .agg(F.min(rank("b")).alias("near"))
            .select("a", F.least("near", rank("a"))["to"].alias("to")),
            "points",
        )
        labels = settle(
            labels.join(points, labels["label"] == points["a"], "left").select(
                "node", F.coalesce("to", "label").alias("label")
            ),
            "labels",
        )
        to_a = points.select("a", F.col("to").alias("to_a"))
        to_b = points.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(to_a, "a").join(to_b, "b").filter("to_a <> to_b")
        edges = settle(
            moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(),
            "edges",
        )
    return labels
