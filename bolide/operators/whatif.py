"""Hits as they would be with one object or pair added or changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bolide.operators.contention import earliest_rock_per_slug
from bolide.operators.matching import first_hit_per_rock


def replaced(objects: DataFrame, new: DataFrame) -> DataFrame:
    """``objects`` with the rows of ``new`` in place of those of the same id."""
    kept = objects.join(new.select("id"), "id", "left_anti")
    return kept.unionByName(new.select(*kept.columns))


def what_if_slug(rocks: DataFrame, slugs: DataFrame, new: DataFrame) -> DataFrame:
    """Per slug the earliest rock, from each rock's first slug, with ``new`` slugs in."""
    return earliest_rock_per_slug(first_hit_per_rock(rocks, replaced(slugs, new)))


def what_if_rock(rocks: DataFrame, slugs: DataFrame, new: DataFrame) -> DataFrame:
    return earliest_rock_per_slug(first_hit_per_rock(replaced(rocks, new), slugs))


def what_if_pair(firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each rock's first slug when hypothetical (rock, slug, t) pairs count too."""
    together = firsts.unionByName(pairs).distinct()
    return (
        together.groupBy("rock")
        .agg(F.min(F.struct("t", "slug")).alias("m"))
        .select("rock", "m.slug", "m.t")
    )


def active_firsts(rocks: DataFrame, firsts: DataFrame) -> DataFrame:
    """Every rock with its first encounter as a struct; fields null without one."""
    f = firsts.select(F.col("rock").alias("id"), "slug", "t")
    return rocks.select(F.col("id")).join(f, "id", "left").select(
        F.col("id").alias("rock"), F.struct("slug", "t").alias("collision")
    )


def any_not_null(df: DataFrame, struct: str) -> DataFrame:
    """Rows whose struct has at least one field that is not null."""
    fields = df.schema[struct].dataType.fieldNames()
    return df.filter(
        F.greatest(*[F.col(f"{struct}.{f}").isNotNull().cast("int") for f in fields]) == 1
    )
