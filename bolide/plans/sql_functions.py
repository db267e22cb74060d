"""The library's functions and table functions for plain SQL, as session functions.

``register`` creates them and the views ``rocks`` and ``slugs`` that the table functions read:

* ``round_away(x, digits)``, ``theta_bin(x)``, ``phi_bin(x)``: rounding and bearing bins
* ``meeting_time(rock_fired, r_0, rock_v, slug_fired, slug_v)``: null if they never meet
* ``track_pos(fired, slope, intercept, t)``: one coordinate of a moving object
* ``collisions_with_slug(id, fired, theta, phi, v)``: the verdict for every rock
* ``hits_of_slug(id, fired, theta, phi, v)``: those without a miss

Their bodies are SQL, so Catalyst puts them in place of each call and plans the whole query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bolide.functions.numeric import PI

_VERDICT = (
    "rock BIGINT, slug BIGINT, t DOUBLE, pos_r DOUBLE, pos_theta DOUBLE, pos_phi DOUBLE, "
    "mdiff_r DOUBLE, mdiff_theta DOUBLE, mdiff_phi DOUBLE, miss STRING"
)
_SLUG = "id BIGINT, fired DOUBLE, theta DOUBLE, phi DOUBLE, v DOUBLE"

SCALARS = {
    "round_away": (
        "x DOUBLE, digits INT",
        "DOUBLE",
        "sign(x) * floor(abs(x) * pow(10D, digits) + 0.5D) / pow(10D, digits) + 0D",
    ),
    "theta_bin": ("x DOUBLE", "DOUBLE", f"round_away(x % {2 * PI!r}D * 100D, 0)"),
    "phi_bin": ("x DOUBLE", "DOUBLE", f"round_away(x % {PI!r}D * 100D, 0)"),
    "track_pos": ("fired DOUBLE, slope DOUBLE, intercept DOUBLE, t DOUBLE", "DOUBLE", "slope * (t - fired) + intercept"),
    "meeting_time": (
        "rock_fired DOUBLE, r_0 DOUBLE, rock_v DOUBLE, slug_fired DOUBLE, slug_v DOUBLE",
        "DOUBLE",
        "CASE WHEN slug_v <> rock_v THEN "
        "slug_fired + (r_0 + rock_v * (slug_fired - rock_fired)) / (slug_v - rock_v) END",
    ),
}

TABLES = {
    "collisions_with_slug": (
        _SLUG,
        _VERDICT,
        """
        SELECT rock, slug, t, CASE WHEN flying THEN slug_r END, CASE WHEN flying THEN slug_theta / 100D END,
               CASE WHEN flying THEN slug_phi / 100D END, CASE WHEN flying THEN round_away(rock_r - slug_r, 2) END,
               CASE WHEN flying THEN (rock_theta - slug_theta) / 100D END,
               CASE WHEN flying THEN (rock_phi - slug_phi) / 100D END,
               CASE WHEN NOT flying THEN 'r'
                    WHEN rock_theta <> slug_theta AND rock_phi <> slug_phi THEN 'theta,phi'
                    WHEN rock_theta <> slug_theta THEN 'theta'
                    WHEN rock_phi <> slug_phi THEN 'phi' END
        FROM (
            SELECT m.rock, m.slug, m.t, coalesce(m.t >= m.rock_fired AND m.t >= m.slug_fired, false) AS flying,
                   round_away(m.r_0 + m.rock_v * (m.t - m.rock_fired), 2) AS rock_r,
                   round_away(m.slug_v * (m.t - m.slug_fired), 2) AS slug_r,
                   theta_bin(track_pos(m.rock_fired, m.m_theta, m.b_theta, m.t)) AS rock_theta,
                   theta_bin(m.theta) AS slug_theta,
                   phi_bin(track_pos(m.rock_fired, m.m_phi, m.b_phi, m.t)) AS rock_phi,
                   phi_bin(m.phi) AS slug_phi
            FROM (
                SELECT r.id AS rock, collisions_with_slug.id AS slug, r.fired_s AS rock_fired,
                       collisions_with_slug.fired AS slug_fired, r.m_theta, r.b_theta, r.m_phi, r.b_phi, r.r_0,
                       r.v AS rock_v, collisions_with_slug.v AS slug_v, collisions_with_slug.theta AS theta,
                       collisions_with_slug.phi AS phi,
                       meeting_time(r.fired_s, r.r_0, r.v, collisions_with_slug.fired, collisions_with_slug.v) AS t
                FROM rocks AS r
            ) AS m
        )
        """,
    ),
    "hits_of_slug": (
        _SLUG,
        "rock BIGINT, t DOUBLE, pos_r DOUBLE",
        """
        SELECT c.rock, c.t, c.pos_r
        FROM collisions_with_slug(hits_of_slug.id, hits_of_slug.fired, hits_of_slug.theta, hits_of_slug.phi, hits_of_slug.v) AS c
        WHERE c.miss IS NULL
        """,
    ),
}


def register(spark: SparkSession, rocks: DataFrame, slugs: DataFrame) -> None:
    """Create the views and functions in the session."""
    rocks.createOrReplaceTempView("rocks")
    slugs.createOrReplaceTempView("slugs")
    for name, (takes, gives, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    for name, (takes, gives, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {body}")
