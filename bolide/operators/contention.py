"""Who competes for whom among the candidate pairs (rock, slug, t).

Ranks go through chunked numbering and counts through partial aggregates, so a
slug or rock with a large share of all pairs is spread over tasks.

All members of a launch class meet the same classes at the same times. The ``_of`` forms count
and rank class edges, and form pairs of objects after the last shuffle: what is shuffled and written follows class edges and
members, while only the result has a row per pair. Where ids are missing or repeat, pairs are formed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.functions.position import SHOT_FIELDS, TRACK_FIELDS
from bolide.operators.matching import numbered_once
from bolide.operators.pairing import (
    Slice,
    candidate_edges,
    default_budget,
    edges_between,
    expand_evenly,
    in_lists,
    member_lists,
    scope_of,
    spread,
    tasks_for,
    with_launch,
)
from bolide.plans.settle import settle
from bolide.plans.skew import id_chunk, ranked, total_before

ORDER = ["t", "rock", "slug"]


def _time_chunk(width: float = 64.0):
    return F.floor(F.col("t") / F.lit(width))


def _class_edges(
    rocks: DataFrame, slugs: DataFrame, budget: float | None
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Written edges between launch classes, and both sides' members; None when a side is empty."""
    scope = scope_of(rocks, slugs)
    if scope is None:
        return None
    r, s = with_launch(rocks, TRACK_FIELDS), with_launch(slugs, SHOT_FIELDS)
    whole = Slice(scope.begin, None)
    edges = edges_between(r, s, whole, scope, default_budget(scope) if budget is None else budget, fold=True)
    return settle(edges, "edges"), r, s


def _counted(edges: DataFrame) -> DataFrame:
    """Class edges with the number of partners of each member of their classes."""
    by_slug = edges.groupBy("s_launch").agg(F.sum("r_n").alias("slug_count"))
    by_rock = edges.groupBy("r_launch").agg(F.sum("s_n").alias("rock_count"))
    return edges.join(by_slug, "s_launch").join(by_rock, "r_launch")


def _based(edges: DataFrame, own: str, other: str) -> DataFrame:
    """Class edges with ``{own}_base``, the partners met before, and ``{own}_ties``, classes met at that very time."""
    met = edges.groupBy(f"{own}_launch", "t").agg(
        F.sum(f"{other}_n").alias("_met"), F.count(F.lit(1)).alias(f"{own}_ties")
    )
    met = total_before(met, [f"{own}_launch"], "t", _time_chunk(), "_met", f"{own}_base")
    return edges.join(met.drop("_met"), [f"{own}_launch", "t"])


def _listed(edges: DataFrame, objects: DataFrame, own: str, other: str) -> DataFrame:
    """Class edges with lists of members, placed among all that the other class meets at that time."""
    tied = F.col(f"{other}_ties") > 1
    key = [f"{own}_launch", f"{other}_launch"]
    alone = edges.filter(~tied).join(member_lists(objects, own), f"{own}_launch")
    together = edges.filter(tied)
    members = together.select(*key, "t").distinct().join(
        objects.select(F.col("launch").alias(f"{own}_launch"), "id"), f"{own}_launch"
    )
    placed = ranked(members, [f"{other}_launch", "t"], ["id"], id_chunk("id"), "place")
    return alone.unionByName(together.join(in_lists(placed, key, own), key))


def _ranked_blocks(edges: DataFrame, r: DataFrame, s: DataFrame) -> DataFrame:
    """Blocks of class edges to be spread, whose pairs have both ranks as base and place."""
    based = settle(_based(_based(edges, "s", "r"), "r", "s"), "edges")
    return _listed(_listed(based, r, "r", "s"), s, "s", "r")


def _ranks() -> dict[str, Column]:
    return {
        "slug_rank": F.col("s_base") + F.col("rock_place"),
        "rock_rank": F.col("r_base") + F.col("slug_place"),
    }


def _pairs_first(rocks: DataFrame, slugs: DataFrame, budget: float | None) -> DataFrame:
    return settle(candidate_edges(rocks, slugs, budget), "candidates")


def contention_counts_of(rocks: DataFrame, slugs: DataFrame, budget: float | None = None) -> DataFrame:
    """``contention_counts`` of all candidate pairs."""
    found = _class_edges(rocks, slugs, budget) if numbered_once(rocks, slugs) else None
    if found is None:
        return contention_counts(_pairs_first(rocks, slugs, budget))
    edges, r, s = found
    pairs = expand_evenly(settle(_counted(edges), "edges"), r, s, "slug_count", "rock_count")
    return pairs.select("rock", "slug", "t", "slug_count", "rock_count")


def contention_ranks_of(rocks: DataFrame, slugs: DataFrame, budget: float | None = None) -> DataFrame:
    """``contention_ranks`` of all candidate pairs."""
    found = _class_edges(rocks, slugs, budget) if numbered_once(rocks, slugs) else None
    if found is None:
        return contention_ranks(_pairs_first(rocks, slugs, budget))
    edges, r, s = found
    pairs = spread(_ranked_blocks(edges, r, s), tasks_for(edges)).withColumns(_ranks())
    return pairs.select("rock", "slug", "t", "slug_rank", "rock_rank")


def mutual_first_of(rocks: DataFrame, slugs: DataFrame, budget: float | None = None) -> DataFrame:
    """``mutual_first`` of all candidate pairs; blocks in which no ranks agree form no pairs."""
    found = _class_edges(rocks, slugs, budget) if numbered_once(rocks, slugs) else None
    if found is None:
        return mutual_first(_pairs_first(rocks, slugs, budget))
    edges, r, s = found
    blocks = _ranked_blocks(settle(_counted(edges), "edges"), r, s)

    def end(side: str, pick, base: str) -> Column:
        return pick(F.transform(f"{side}_list", lambda m: m["place"])) + F.col(base)

    meet = (end("r", F.array_min, "s_base") <= end("s", F.array_max, "r_base")) & (
        end("s", F.array_min, "r_base") <= end("r", F.array_max, "s_base")
    )
    both = spread(blocks.filter(meet), tasks_for(edges)).withColumns(_ranks())
    keep = both.filter(F.col("slug_rank") == F.col("rock_rank"))
    columns = ["rock", "slug", "t", "slug_rank", "rock_rank", "slug_count", "rock_count"]
    return keep.select(*columns).orderBy("rock", "slug")


def contention_counts(pairs: DataFrame) -> DataFrame:
    """Each pair with the number of pairs of its slug and of its rock."""
    by_slug = pairs.groupBy("slug").agg(F.count(F.lit(1)).alias("slug_count"))
    by_rock = pairs.groupBy("rock").agg(F.count(F.lit(1)).alias("rock_count"))
    return pairs.join(by_slug, "slug").join(by_rock, "rock").select(
        "rock", "slug", "t", "slug_count", "rock_count"
    )


def contention_totals(rocks: DataFrame, slugs: DataFrame, budget: float | None = None) -> DataFrame:
    """(kind, id, pairs): how many candidate partners each rock and slug has, for those with any.

    From edges between launch classes and their numbers of members; no pair of objects is formed, and
    the work follows the class edges.
    """
    found = _class_edges(rocks, slugs, budget)
    if found is None:
        return rocks.sparkSession.createDataFrame([], "kind string, id long, pairs long")
    edges, r, s = found

    def totals(kind: str, objects: DataFrame, own: str, other: str) -> DataFrame:
        per_class = edges.groupBy(F.col(f"{own}_launch").alias("launch")).agg(F.sum(f"{other}_n").alias("pairs"))
        return objects.join(per_class, "launch").select(F.lit(kind).alias("kind"), "id", "pairs")

    return totals("rock", r, "r", "s").unionByName(totals("slug", s, "s", "r"))


def contention_ranks(pairs: DataFrame) -> DataFrame:
    """Each pair with its place in its slug's and its rock's time order."""
    by_slug = ranked(pairs, ["slug"], ORDER, _time_chunk(), "slug_rank")
    return ranked(by_slug, ["rock"], ORDER, _time_chunk(), "rock_rank")


def mutual_first(pairs: DataFrame) -> DataFrame:
    """One-pass approximation of the matching from ranks and counts.

    A pair is kept when it is alone on both sides, when it is first on its
    contested side, or, contested on both, when both ranks agree.
    """
    both = contention_ranks(pairs).join(
        contention_counts(pairs).drop("t"), ["rock", "slug"]
    )
    # Where a side is uncontested its rank is 1, so equal ranks cover that case too.
    keep = F.col("slug_rank") == F.col("rock_rank")
    return both.filter(keep).orderBy("rock", "slug")


def first_rock_per_slug(firsts: DataFrame) -> DataFrame:
    """Lowest rock per slug, then earliest time."""
    return firsts.groupBy("slug").agg(F.min(F.struct("rock", "t")).alias("m")).select(
        "slug", "m.rock", "m.t"
    )


def earliest_rock_per_slug(firsts: DataFrame) -> DataFrame:
    """One row per slug: the earliest, then the lowest rock."""
    return firsts.groupBy("slug").agg(F.min(F.struct("t", "rock")).alias("m")).select(
        "slug", "m.rock", "m.t"
    )


def matching_invariants(hits: DataFrame) -> DataFrame:
    """Hits, distinct rocks and distinct slugs; a matching has all three equal."""
    return hits.agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_distinct("rock").alias("rocks"),
        F.count_distinct("slug").alias("slugs"),
    ).withColumn("ok", (F.col("hits") == F.col("rocks")) & (F.col("hits") == F.col("slugs")))
