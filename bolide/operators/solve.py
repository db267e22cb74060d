"""From observations to trajectories, and from trajectories to launches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bolide.functions.numeric import LIGHT_SPEED, is_close
from bolide.functions.position import track, track_pos
from bolide.plans.skew import ranked

_SEEN = ["obs_s", "pos_r", "pos_theta", "pos_phi"]


def observation_pairs(observations: DataFrame, keys: list[str]) -> DataFrame:
    """First and second, third and fourth, ... observation of each object.

    Numbered in chunks of time and then folded per pair, so an object with very
    many observations is no single task's work. A lone last one is left out.
    """
    numbered = ranked(
        observations, keys, ["obs_s", "obs_no"], F.floor(F.col("obs_s") / 3600.0), "_n"
    )
    seen = F.struct(*_SEEN)
    return (
        numbered.withColumn("pair_no", F.floor((F.col("_n") - 1) / 2))
        .groupBy(*keys, "pair_no")
        .agg(
            F.count(F.lit(1)).alias("_c"),
            F.min_by(seen, "_n").alias("a"),
            F.max_by(seen, "_n").alias("b"),
        )
        .filter("_c = 2")
        .drop("_c")
    )


def fit_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Launch parameters through the two observations ``a`` and ``b``.

    Times count from launch. ``consistent`` tells whether both observations
    give the same intercepts to nine digits.
    """
    t0 = F.col("a.obs_s") - F.col("fired_s")
    t1 = F.col("b.obs_s") - F.col("fired_s")
    apart = F.when(t0 != t1, t0 - t1)

    def line(field: str):
        y0, y1 = F.col(f"a.{field}"), F.col(f"b.{field}")
        slope = (y0 - y1) / apart
        return slope, y0 - slope * t0, y1 - slope * t1

    v, r_orig, r_check = line("pos_r")
    m_theta, b_theta, theta_check = line("pos_theta")
    m_phi, b_phi, phi_check = line("pos_phi")
    return pairs.select(
        *keys,
        "pair_no",
        F.col("b.obs_s").alias("last_obs_s"),
        v.alias("v"),
        r_orig.alias("r_0"),
        m_theta.alias("m_theta"),
        b_theta.alias("b_theta"),
        m_phi.alias("m_phi"),
        b_phi.alias("b_phi"),
        (
            is_close(r_orig, r_check)
            & is_close(b_theta, theta_check)
            & is_close(b_phi, phi_check)
        ).alias("consistent"),
    )


def two_point_fit(observations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["name", "fired_s"]
    return fit_pairs(observation_pairs(observations, keys), keys)


def firing_solutions(
    fits: DataFrame, slug_v: float = LIGHT_SPEED / 10, delay_s: float = 5.0
) -> DataFrame:
    """Bearing and time of the meeting with a slug fired ``delay_s`` after the fit.

    No solution (nulls) where both have the same speed.
    """
    slug = F.lit(float(slug_v))
    launch = F.col("last_obs_s") + F.lit(float(delay_s))
    closing = F.when(F.col("v") != slug, F.col("v") - slug)
    t = (F.col("v") * F.col("fired_s") - F.col("r_0") - slug * launch) / closing
    age = t - F.col("fired_s")
    return fits.select(
        "name",
        "fired_s",
        "pair_no",
        launch.alias("launch_s"),
        t.alias("t_collide"),
        (F.col("v") * age + F.col("r_0")).alias("r_collide"),
        (F.col("m_theta") * age + F.col("b_theta")).alias("theta"),
        (F.col("m_phi") * age + F.col("b_phi")).alias("phi"),
    )


def sample_trajectory(rocks: DataFrame, until_s: int, step_s: int = 1) -> DataFrame:
    """Positions over a grid of ages, r clipped at 0.

    Below r = 1 the bearing stays what it was at the first such grid point.
    The grid is one array per rock, so no shuffle is needed.
    """
    rock = track()
    grid = F.sequence(F.lit(0), F.lit(until_s), F.lit(step_s))
    low = F.filter(grid, lambda k: F.col("r_0") + F.col("v") * k.cast("double") < 1)
    sampled = rocks.withColumn("_stop", F.try_element_at(low, F.lit(1)).cast("double"))
    sampled = sampled.withColumn("_k", F.explode(grid)).withColumn(
        "age_s", F.col("_k").cast("double")
    )
    age = F.col("age_s")
    r = F.col("r_0") + F.col("v") * age
    held = F.when(r < 1, F.col("_stop")).otherwise(age)
    at = track_pos(rock._replace(fired_s=F.lit(0.0)), held)
    return sampled.select(
        "id",
        "age_s",
        F.greatest(r, F.lit(0.0)).alias("pos_r"),
        at.theta.alias("pos_theta"),
        at.phi.alias("pos_phi"),
    )
