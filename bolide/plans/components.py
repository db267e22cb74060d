"""Connected components of a graph whose edges are a table, in a few joins and aggregates.

Per round each node takes the neighbour with the lowest scrambled number as its
pointer, and the graph is drawn anew between the pointers, without loops and repeats.
A constant share of the nodes goes in every round, on chains as on stars. What is left below a counted
``FEW`` edges is finished on the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bolide.plans.settle import settle


# Edges of the contracted graph that may come to the driver; counted before.
FEW = 100_000


def _order(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("scrambled"), F.col(node).alias("node"))


def _roots(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, root) of every node of a few pairs."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in pairs:
        above[root(a)] = root(b)
    return [(x, root(x)) for x in list(above)]


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: long), with one label per component."""
    live, labels = edges.filter("a <> b").select("a", "b").distinct(), None
    while True:
        # One more than ``few`` tells whether it is the rest.
        rows = live.limit(few + 1).collect()
        if len(rows) <= few:
            return _moved(labels, _points(edges.sparkSession, _roots([(r["a"], r["b"]) for r in rows])))
        if labels is None:
            live = settle(live, "edges")
        mirrored = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = F.least(F.min(_order("b")), F.min(_order("a"))).getField("node")
        points = settle(mirrored.groupBy("a").agg(to.alias("to")), "points")
        labels = _moved(labels, points)
        at_a = points.select("a", F.col("to").alias("to_a"))
        at_b = points.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        between = live.join(at_a, "a").join(at_b, "b").filter("to_a <> to_b")
        live = between.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        live = settle(live.distinct(), "edges")


def _points(spark: SparkSession, rows: list[tuple[int, int]]) -> DataFrame:
    """Few rows as a table that is part of the plan, so that no Python task makes it."""
    node, to = ([r[i] for r in rows] for i in (0, 1))
    return spark.createDataFrame(pa.table({"a": pa.array(node, "int64"), "to": pa.array(to, "int64")}))


def _moved(labels: DataFrame | None, points: DataFrame) -> DataFrame:
    """Labels after each (a) has gone to what it points to."""
    if labels is None:
        return points.select(F.col("a").alias("node"), F.col("to").alias("label"))
    moved = points.select(F.col("a").alias("label"), "to")
    joined = labels.join(moved, "label", "left")
    return settle(joined.select("node", F.coalesce("to", "label").alias("label")), "labels")
