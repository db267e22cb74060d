"""Rocks, slugs and hits as they were recorded: periods of every table, joined over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.operators.history import current_at, history_intervals, opening_versions
from bolide.plans.periods import lasting, overlap_join
from bolide.plans.settle import settle


def day_of(at: Column) -> Column:
    return F.datediff(at, F.lit("1970-01-01"))


def recorded_periods(table: DataFrame, feed: DataFrame, key: str, start: Column) -> DataFrame:
    """Periods of a table that had rows when its history began.

    ``feed`` has the table's columns, ``changed_at``, ``seq`` and ``gone``, which marks
    deletions. Rows of ``table`` hold from an hour before ``start`` to their first change. A version that
    another one replaces in the same instant has an empty period and is left out.
    """
    opening = (
        opening_versions(table, start)
        .withColumnRenamed("valid_from", "changed_at")
        .withColumns({"seq": F.lit(-1).cast("long"), "gone": F.lit(False)})
        .select(*feed.columns)
    )
    spans = history_intervals(opening.unionByName(feed), key, deleted=F.col("gone"))
    return lasting(spans.drop("seq", "gone"))


def world_at(rocks: DataFrame, slugs: DataFrame, hits: DataFrame, when: Column) -> DataFrame:
    """Hits recorded at ``when`` with the rock and the slug as recorded then."""
    now = [current_at(t, when).drop("valid_from", "valid_to") for t in (rocks, slugs, hits)]
    return now[2].join(now[0], "rock").join(now[1], "slug")


def hits_over_time(rocks: DataFrame, slugs: DataFrame, hits: DataFrame) -> DataFrame:
    """Each hit with every state of its rock and slug while it was recorded, and the period of each.

    Slugs come first, as a slug has few versions, so the larger join is the last.
    """
    with_slugs = settle(overlap_join(hits, slugs, ["slug"], day_of), "hits-with-slugs")
    return overlap_join(with_slugs, rocks, ["rock"], day_of)


def hit_records(rocks: DataFrame, slugs: DataFrame, hits: DataFrame, end: Column) -> DataFrame:
    """Per recorded hit, the states it went through up to ``end``: how many, how long, the mass met.

    ``hits`` needs ``hit_no``, which names a recorded hit.
    """
    states = hits_over_time(rocks, slugs, hits).filter(F.col("valid_from") < end)
    days = F.datediff(F.least("valid_to", end), F.col("valid_from"))
    return states.groupBy("hit_no", "slug", "rock").agg(
        F.count(F.lit(1)).alias("states"),
        F.sum(days).cast("long").alias("days"),
        F.sum(days * F.col("mass")).cast("long").alias("mass_days"),
        F.max("v").alias("top_v"),
    )
