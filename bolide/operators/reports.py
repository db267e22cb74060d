"""Dashboard and console reports over the active objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bolide.functions.numeric import at_seconds, eta_signed, seconds_of_day, time_to_impact
from bolide.functions.position import track, track_pos


def _age_of_day():
    return seconds_of_day(F.col("age_s")).alias("age_of_day_s")


def oldest_rocks(objects: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` oldest active rocks with distance and time to impact."""
    top = objects.filter("type = 'rock'").orderBy(F.desc("age_s"), "id").limit(n)
    v = F.col("rock_params.v")
    return top.select(
        "id",
        "name",
        F.col("pos_r").alias("distance"),
        time_to_impact(F.col("pos_r"), v).alias("time_to_impact"),
        "age_s",
        _age_of_day(),
        F.coalesce("target", F.lit("?")).alias("target"),
    )


def newest_slugs(objects: DataFrame, n: int = 5) -> DataFrame:
    top = objects.filter("type = 'slug'").orderBy("age_s", "id").limit(n)
    return top.select(
        "id",
        "name",
        F.col("pos_r").alias("distance"),
        "age_s",
        _age_of_day(),
        F.coalesce("target", F.lit("?")).alias("target"),
    )


def impact_report(impacts: DataFrame, epoch: str) -> DataFrame:
    """One status line per impact, with the clock time of day."""
    when = at_seconds(F.lit(epoch), F.col("t"))
    return impacts.select(
        F.substring("rock", 1, 20).alias("rock"),
        F.substring("target", 1, 15).alias("target"),
        F.date_format(when, "HH:mm:ss").alias("clock"),
        F.date_format(F.date_trunc("day", when), "yyyy-MM-dd").alias("day"),
        F.lit("vaporized").alias("status"),
    )


def eta(objects: DataFrame) -> DataFrame:
    """Signed ETA of active rocks: negative means inbound."""
    return objects.filter("type = 'rock'").select(
        "id",
        "name",
        F.coalesce("target", F.lit("unknown")).alias("target"),
        "type",
        eta_signed(F.col("pos_r"), F.col("rock_params.v")).alias("eta"),
    )


def impact_countdown(objects: DataFrame) -> DataFrame:
    """Time to impact of every active rock, infinite unless inbound."""
    return objects.filter("type = 'rock'").select(
        "id", time_to_impact(F.col("pos_r"), F.col("rock_params.v")).alias("time_to_impact")
    )


def last_position(observations: DataFrame) -> DataFrame:
    """Latest observed position per name, by name."""
    return (
        observations.groupBy("name")
        .agg(F.max_by(F.struct("pos_r", "pos_theta", "pos_phi"), F.struct("obs_s", "obs_no")).alias("p"))
        .select("name", "p.pos_r", "p.pos_theta", "p.pos_phi")
        .orderBy("name")
    )


def octant_histogram(objects: DataFrame) -> DataFrame:
    return objects.groupBy("octant", "type").agg(F.count(F.lit(1)).alias("n"))


def all_clear(rocks: DataFrame, hits: DataFrame, rounds: list[float]) -> DataFrame:
    """Per scan round: active rocks seen, and whether there were none.

    One pass over the rocks serves all rounds.
    """
    times = F.array(*[F.lit(float(r)) for r in rounds])
    ended = hits.select(F.col("rock").alias("id"), F.col("t").alias("_hit"))
    at = F.col("round_s")
    r = track_pos(track(), at).r
    up = rocks.join(ended, "id", "left").withColumn("round_s", F.explode(times)).filter(
        (F.col("fired_s") <= at) & (F.col("_hit").isNull() | (F.col("_hit") > at)) & (r >= 0)
    )
    seen = up.groupBy("round_s").agg(F.count(F.lit(1)).alias("n"))
    every = rocks.sparkSession.createDataFrame([(float(x),) for x in rounds], "round_s double")
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    return every.join(seen, "round_s", "left").select(
        "round_s", n.alias("rocks"), (n == 0).alias("all_clear")
    )
