"""Joins of period tables by overlap, each pair met once, with work that follows the result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.plans.settle import settle

# Children of a node of the tree over time.
BASE = 8
# Rows of a key that meet in one place; keys with more are dealt over a tree.
CROWD = 1 << 13
SPAN = {"valid_from", "valid_to"}


def _between(first: Column, last: Column) -> Column:
    """The whole numbers from ``first`` to ``last``, none if they are the wrong way round."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _nodes_over(first: Column, last: Column, levels: int) -> Column:
    """The fewest nodes that together hold the bins ``first`` to ``last`` and no others."""
    found = []
    for level in range(levels):
        width, wider = BASE**level, BASE ** (level + 1)
        low, high = F.ceil(first / width), F.floor((last + 1) / width)
        nodes = _between(low, high - 1)
        if level + 1 < levels:
            up_low, up_high = F.ceil(first / wider) * BASE, F.floor((last + 1) / wider) * BASE
            edges = F.concat(_between(low, up_low - 1), _between(up_high, high - 1))
            nodes = F.when(up_low < up_high, edges).otherwise(nodes)
        found.append(F.transform(nodes, _node_of(level)))
    return reduce(F.concat, found)


def _node_of(level: int) -> Callable[[Column], Column]:
    return lambda node: F.struct(F.lit(level).alias("level"), node.alias("node"))


def _nodes_above(at: Column, levels: int) -> Column:
    """The node of each level that holds the bin ``at``."""
    return F.array(
        *[_node_of(level)(F.floor(at / BASE**level)) for level in range(levels)]
    )


def lasting(periods: DataFrame) -> DataFrame:
    """Periods that are not empty; a null end is open."""
    return periods.filter(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))


def _crowded(sides: list[DataFrame], keys: list[str], most: int) -> DataFrame:
    """Keys with more than ``most`` rows of both sides together: at most a row for so many rows."""
    named = sides[0].select(*keys).unionAll(sides[1].select(*keys))
    counted = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return settle(counted.filter(F.col("_n") > most).dropna(subset=keys).drop("_n"), "crowded")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    bin_of: Callable[[Column], Column],
    crowd: int = CROWD,
) -> DataFrame:
    """Rows of both sides with equal keys whose periods [valid_from, valid_to) share an instant.

    A key with at most ``crowd`` rows meets in one place: each of its rows is moved once, and it tests at most
    ``crowd`` / 2 times as many pairs as it has rows. The keys with more, counted beforehand, meet in a tree over time
    (``_met_in_nodes``), where a hot key is dealt over many tasks. Neither side is
    broadcast: the size of a file says little about its rows. ``bin_of`` maps a time to a whole number that never falls
    as time goes on. The result has the period that both share. Empty periods and null
    keys meet nothing; an empty side gives an empty result.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys) - SPAN
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    left, right = lasting(left), lasting(right)
    hot = _crowded([left, right], keys, crowd)
    if hot.isEmpty():
        return _met_by_key(left, right, keys)
    of = lambda df, how: df.join(F.broadcast(hot), keys, how)
    few = _met_by_key(of(left, "left_anti"), of(right, "left_anti"), keys)
    return few.unionByName(_met_in_nodes(of(left, "left_semi"), of(right, "left_semi"), keys, bin_of))


def _met_by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    def side(df: DataFrame, mark: str) -> DataFrame:
        rest = [c for c in df.columns if c not in SPAN and c not in keys]
        return df.select(*keys, *rest, *[F.col(f"valid_{end}").alias(f"_{mark}_{end}") for end in ("from", "to")])

    begin, end = F.greatest("_l_from", "_r_from"), F.least("_l_to", "_r_to")
    return (
        side(right, "r").hint("merge").join(side(left, "l"), keys)
        .filter(end.isNull() | (begin < end))
        .withColumn("valid_from", begin)
        .withColumn("valid_to", end)
        .drop("_l_from", "_l_to", "_r_from", "_r_to")
    )


def _met_in_nodes(
    left: DataFrame, right: DataFrame, keys: list[str], bin_of: Callable[[Column], Column]
) -> DataFrame:
    """The same by a tree over time, for keys of any number of rows.

    Of two periods that overlap, one begins inside the other. Each period is cut into
    nodes of a tree over time, at most 2 * (BASE - 1) a level, and each beginning goes to the
    node above it on every level, so a pair meets in exactly one node by an equi-join. All that meets
    in a node overlaps, but for the first and last bin of a period: a hot key costs
    what it yields, and its rows spread over its nodes.
    """
    begins = left.select(bin_of(F.col("valid_from")).alias("b")).unionAll(
        right.select(bin_of(F.col("valid_from")).alias("b"))
    )
    reach = begins.agg(F.min("b").alias("low"), F.max("b").alias("high")).first()
    low, high = reach["low"] or 0, reach["high"] or 0
    levels = 1
    while BASE ** (levels - 1) <= high - low:
        levels += 1

    def side(df: DataFrame, mark: str, nodes: Column) -> DataFrame:
        rest = [F.col(c) for c in df.columns if c not in SPAN and c not in keys]
        return df.select(
            *keys,
            *rest,
            F.col("valid_from").alias(f"_{mark}_from"),
            F.col("valid_to").alias(f"_{mark}_to"),
            F.explode(nodes).alias("_node"),
        )

    def met(begun: DataFrame, lying: DataFrame, within: Column) -> DataFrame:
        begin = bin_of(F.col("valid_from")) - low
        end = F.least(F.coalesce(bin_of(F.col("valid_to")), F.lit(high)), F.lit(high)) - low
        points = side(begun, "p", _nodes_above(begin.cast("long"), levels))
        covers = side(lying, "c", _nodes_over(begin.cast("long"), end.cast("long"), levels))
        inside = within & (F.col("_c_to").isNull() | (F.col("_p_from") < F.col("_c_to")))
        return (
            points.hint("merge").join(covers, [*keys, "_node"])
            .filter(inside)
            .withColumn("valid_from", F.col("_p_from"))
            .withColumn("valid_to", F.least("_p_to", "_c_to"))
            .drop("_node", "_p_from", "_p_to", "_c_from", "_c_to")
        )

    later = met(right, left, F.col("_c_from") <= F.col("_p_from"))
    earlier = met(left, right, F.col("_c_from") < F.col("_p_from"))
    return later.unionByName(earlier)
