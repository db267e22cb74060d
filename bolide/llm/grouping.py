"""Groups of linked members of buckets, without comparing all pairs of a bucket.

``members`` (key, id) says who shares a bucket; a link is a pair of one bucket that
``verify`` confirms. Wanted are the connected groups of all links. Most members of a
bucket are linked to one of a few central ones, so comparisons go by rounds: each member
is compared with the bucket's pivots of *other* groups only, and what is linked is merged
before the next round. The first pivot of a bucket is the member that shares most buckets
with others. After these rounds the members of a bucket that is still in several groups
are pivots in round k if their hash is below ``FACTOR``^k / n, so pivots grow from a few a bucket to
all of it, and buckets whose members have come together drop out. ``bound`` may rule out
pairs that can't be links before they are formed. The last round has compared or
ruled out every pair of a bucket whose ends are still apart: no link can be missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.llm.components import contract
from bolide.plans.settle import settle

FACTOR = 8
_SPACE = float(1 << 53)


def _share(*names: str):
    """A number in [0, 1) from the columns' hash."""
    return F.shiftrightunsigned(F.xxhash64(*names), 11) / F.lit(_SPACE)


def linked_groups(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    bound: Callable[[DataFrame], DataFrame] | None = None,
    least: float = 0.0,
    possible: Column | None = None,
) -> DataFrame:
    """(node, label) of every id in a bucket of two or more: equal labels are one group.

    ``verify`` takes pairs (a, b) and returns those that are links. ``bound`` takes the ids (id) still to
    be compared and gives their ``total`` weight and the weight ``shared`` with any other of
    them; a pair's similarity, weight in both by weight in either, must reach ``least``.
    ``possible`` is a cheap necessary condition of a link over further columns of ``members``; those of the
    pair's other member have the suffix ``_b``.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = settle(members.join(sizes, "key"), "sized")
    mates = sized.groupBy("id").agg(F.sum("n").alias("mates"))
    live = sized.join(mates, "id").withColumn("share", _share("id", "key"))
    pivots = live.groupBy("key").agg(F.max_by("id", F.struct("mates", "share")).alias("pivot"))
    live = settle(live.join(pivots, "key"), "members")
    labels = settle(live.select(F.col("id").alias("node"), F.col("id").alias("label")).distinct(), "labels")
    # First the pivot of each member's largest bucket, one comparison a member ...
    nearest = live.groupBy("id").agg(F.max_by("pivot", F.struct("n", "key")).alias("pivot"))
    labels = _merged(labels, nearest.select(F.col("id").alias("a"), F.col("pivot").alias("b")), verify)
    # ... then the pivots of its other buckets that are still in another group.
    apart = _labelled(_labelled(live, labels), labels, "pivot", "of_pivot").filter("label <> of_pivot")
    labels = _merged(labels, apart.select(F.col("id").alias("a"), F.col("pivot").alias("b")), verify)
    live = _still_apart(live.drop("mates", "pivot"), labels)
    possible = F.lit(True) if possible is None else possible
    if bound is not None and not live.isEmpty():
        weights = bound(live.select("id").distinct())
        live = live.join(weights.filter(F.col("shared") >= least * F.col("total")), "id").drop("label")
        both = F.least("shared", "shared_b")
        possible = possible & (both >= least * (F.col("total") + F.col("total_b") - both))
    else:
        live = live.drop("label")
    # A pair is formed once, in the first bucket that both are in.
    own = live.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    live = settle(live.join(own, "id"), "live")
    reach = 1
    while True:
        live = _still_apart(live, labels)
        largest = live.agg(F.max("n")).first()[0]
        if largest is None:
            return labels
        once = F.array_min(F.array_intersect("keys", "keys_b")) == F.col("key")
        # Those that were pivots before have been compared with everybody.
        rank = F.col("share") * F.col("n")
        new = live.filter((rank < reach * FACTOR) & (rank >= (reach if reach > 1 else 0)))
        right = new.select(*[F.col(c).alias(f"{c}_b") for c in live.columns])
        pairs = live.join(
            right,
            (F.col("key") == F.col("key_b"))
            & (F.col("label") != F.col("label_b"))
            & (F.struct("share", "id") > F.struct("share_b", "id_b"))
            & possible
            & once,
        )
        labels = _merged(labels, pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b")), verify)
        reach *= FACTOR
        if reach >= largest:
            return labels


def _labelled(df: DataFrame, labels: DataFrame, name: str = "id", out: str = "label") -> DataFrame:
    found = labels.select(F.col("node").alias(name), F.col("label").alias(out))
    return df.join(found, name)


def _still_apart(live: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one group, with their current label."""
    now = settle(_labelled(live.drop("label"), labels), "live")
    mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return settle(now.join(mixed.filter("low < high").select("key"), "key", "left_semi"), "live")


def _merged(labels: DataFrame, pairs: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    once = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = settle(verify(settle(once, "pairs")), "links")
    ends = _labelled(_labelled(links.select("a", "b"), labels, "a", "of_a"), labels, "b", "of_b")
    return contract(labels, ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
