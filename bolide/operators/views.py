"""Objects, hits and impacts as seen at a given time.

Every view takes its time as an argument, so a plan is repeatable and its
filters are literals that reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.functions.encounter import collide, encounter_columns, impact
from bolide.functions.numeric import round_away, seconds_of_day
from bolide.functions.position import (
    SHOT_FIELDS,
    TRACK_FIELDS,
    Cartesian,
    Pos,
    octant,
    shot,
    shot_pos,
    to_cartesian,
    track,
    track_pos,
)

ROCK_PARAMS = TRACK_FIELDS[1:]
SLUG_PARAMS = SHOT_FIELDS[1:]
HIT_DETAILS = ["pos_r", "pos_theta", "pos_phi", "mdiff_r", "mdiff_theta", "mdiff_phi"]


def _prefixed(df: DataFrame, prefix: str, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def hit_details(hits: DataFrame, rocks: DataFrame, slugs: DataFrame) -> DataFrame:
    """Hits with the place of the encounter and the remaining differences."""
    r = _prefixed(rocks, "r_", ("id", *TRACK_FIELDS))
    s = _prefixed(slugs, "s_", ("id", *SHOT_FIELDS))
    joined = hits.join(r, hits.rock == r.r_id).join(s, hits.slug == s.s_id)
    columns = encounter_columns(collide(track("r_"), shot("s_"), F.col("t")))
    return joined.select("rock", "slug", *columns[:-1])


def collisions_of_slug(rocks: DataFrame, slug_id: int, launch: dict[str, float]) -> DataFrame:
    """Verdict of one slug against every rock: a projection, no join."""
    slug = shot()._replace(**{k: F.lit(float(v)) for k, v in launch.items()})
    return rocks.select(
        F.col("id").alias("rock"),
        F.lit(slug_id).cast("long").alias("slug"),
        *encounter_columns(collide(track(), slug)),
    )


def collisions_of_rock(slugs: DataFrame, rock_id: int, launch: dict[str, float]) -> DataFrame:
    """Verdict of one rock against every slug: a projection, no join."""
    rock = track()._replace(**{k: F.lit(float(v)) for k, v in launch.items()})
    return slugs.select(
        F.lit(rock_id).cast("long").alias("rock"),
        F.col("id").alias("slug"),
        *encounter_columns(collide(rock, shot())),
    )


def named(pairs: DataFrame, rocks: DataFrame, slugs: DataFrame) -> DataFrame:
    """Pairs with the names of both objects."""
    r = rocks.select(F.col("id").alias("rock"), F.col("name").alias("rock_name"))
    s = slugs.select(F.col("id").alias("slug"), F.col("name").alias("slug_name"))
    return pairs.join(r, "rock").join(s, "slug")


def _sighted(df: DataFrame, pos: Pos, late: Pos, as_of: float) -> DataFrame:
    """Adds positions, then what follows from them, one stage per use.

    Later stages refer to columns of earlier ones, so no sine or cosine is
    written (or planned) twice.
    """
    for prefix, p in (("", pos), ("delay_", late)):
        df = df.withColumns(
            {
                f"_{prefix}r": p.r,
                f"_{prefix}theta": p.theta,
                f"_{prefix}phi": p.phi,
            }
        )
    for prefix in ("", "delay_"):
        at = Pos(*[F.col(f"_{prefix}{n}") for n in ("r", "theta", "phi")])
        c = to_cartesian(at)
        df = df.withColumns({f"_{prefix}{n}": part for n, part in zip("xyz", c)})
    df = df.withColumns(
        {
            f"{prefix}octant": octant(Cartesian(*[F.col(f"_{prefix}{n}") for n in "xyz"]))
            for prefix in ("", "delay_")
        }
    )
    return df.withColumns(
        {"t": F.lit(float(as_of)), "age_s": F.lit(float(as_of)) - F.col("fired_s")}
    )


def _seen_columns() -> list[Column]:
    spherical, cartesian = ("r", "theta", "phi"), ("x", "y", "z")
    return [
        *[F.col(f"_{n}").alias(f"pos_{n}") for n in spherical],
        *[round_away(F.col(f"_delay_{n}"), 6).alias(f"delay_pos_{n}") for n in spherical],
        *[round_away(F.col(f"_{n}"), 6).alias(f"cpos_{n}") for n in cartesian],
        *[round_away(F.col(f"_delay_{n}"), 6).alias(f"delay_cpos_{n}") for n in cartesian],
        *[F.col(c) for c in ("octant", "delay_octant", "t", "age_s")],
    ]


def _with_hit(objects: DataFrame, hits: DataFrame, side: str) -> DataFrame:
    h = hits.select(
        F.col(side).alias("id"),
        F.col("t").alias("collided_s"),
        *[F.col(c).alias(f"collision_{c}") for c in HIT_DETAILS],
    )
    return objects.join(h, "id", "left")


_COLLISION = ["collided_s", *[f"collision_{c}" for c in HIT_DETAILS]]


def rocks_at(rocks: DataFrame, hits: DataFrame, as_of: float) -> DataFrame:
    """Every rock with its hit, and its position at ``as_of``."""
    t, rock = F.lit(float(as_of)), track()
    seen = _sighted(rocks, track_pos(rock, t), track_pos(rock, t, delay=True), as_of)
    return _with_hit(seen, hits, "rock").select(
        "id", "name", "target", "mass", "fired_s", *ROCK_PARAMS, *_COLLISION, *_seen_columns()
    )


def slugs_at(slugs: DataFrame, hits: DataFrame, as_of: float) -> DataFrame:
    t, slug = F.lit(float(as_of)), shot()
    seen = _sighted(slugs, shot_pos(slug, t), shot_pos(slug, t, delay=True), as_of)
    return _with_hit(seen, hits, "slug").select(
        "id", "name", "target", "fired_s", *SLUG_PARAMS, *_COLLISION, *_seen_columns()
    )


def all_objects(
    rocks: DataFrame, slugs: DataFrame, hits: DataFrame, as_of: float
) -> DataFrame:
    """Rocks and slugs under one schema.

    (type, id) is unique, so the union needs no duplicate removal.
    """

    def nest(columns: tuple[str, ...]) -> Column:
        return F.struct(*columns)

    r = rocks_at(rocks, hits, as_of).withColumn("rock_params", nest(ROCK_PARAMS))
    s = slugs_at(slugs, hits, as_of).withColumn("slug_params", nest(SLUG_PARAMS))
    r_type, s_type = r.schema["rock_params"].dataType, s.schema["slug_params"].dataType
    r = r.withColumn("type", F.lit("rock")).withColumn("slug_params", F.lit(None).cast(s_type))
    s = (
        s.withColumn("type", F.lit("slug"))
        .withColumn("mass", F.lit(1).cast("long"))
        .withColumn("rock_params", F.lit(None).cast(r_type))
    )
    drop = [*ROCK_PARAMS, *SLUG_PARAMS]
    return r.drop(*drop).unionByName(s.drop(*drop))


def active(objects: DataFrame, as_of: float) -> DataFrame:
    """Launched, not yet hit, and not past the origin."""
    t = F.lit(float(as_of))
    alive = F.col("collided_s").isNull() | (F.col("collided_s") > t)
    return objects.filter((F.col("fired_s") <= t) & alive & (F.col("pos_r") >= 0))


def active_objects(
    rocks: DataFrame, slugs: DataFrame, hits: DataFrame, as_of: float
) -> DataFrame:
    return active(all_objects(rocks, slugs, hits, as_of), as_of)


def _telescope(objects: DataFrame) -> DataFrame:
    return objects.select(
        "id",
        "type",
        "name",
        "target",
        "mass",
        "fired_s",
        "pos_r",
        "pos_theta",
        "pos_phi",
        "cpos_x",
        "cpos_y",
        "cpos_z",
        F.col("t").alias("obs_s"),
        "octant",
        seconds_of_day(F.floor("age_s").cast("double")).alias("age"),
    )


def observe_octant(objects: DataFrame, number: int) -> DataFrame:
    """Active objects in one octant, in the shape of an observation."""
    if not 1 <= number <= 8:
        raise ValueError(f"octant {number} is not in 1..8")
    return _telescope(objects.filter(F.col("octant") == number))


def sky_scan(objects: DataFrame) -> DataFrame:
    """All eight octants in one pass over the active objects."""
    return _telescope(objects.filter(F.col("octant").isNotNull()))


def lookup_object(objects: DataFrame, kind: str, number: int) -> DataFrame:
    return objects.filter((F.col("type") == kind) & (F.col("id") == number))


def observation_json(seen: DataFrame, epoch: str) -> DataFrame:
    """Observations as JSON text with nested positions and ISO-8601 times."""
    start = F.lit(epoch).cast("timestamp")

    def iso(seconds: str) -> Column:
        return F.timestamp_micros(
            F.unix_micros(start) + F.floor(F.col(seconds) * 1e6 + 0.5)
        )

    body = F.struct(
        "id",
        "type",
        "name",
        "target",
        "mass",
        iso("fired_s").alias("fired"),
        F.struct(
            F.col("pos_r").alias("r"), F.col("pos_theta").alias("theta"), F.col("pos_phi").alias("phi")
        ).alias("pos"),
        F.struct(
            F.col("cpos_x").alias("x"), F.col("cpos_y").alias("y"), F.col("cpos_z").alias("z")
        ).alias("cpos"),
        iso("obs_s").alias("obs_time"),
        "octant",
        F.col("age").cast("long").alias("age"),
    )
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return seen.select("id", "type", F.to_json(body, options).alias("body"))


def unhit_rocks(rocks: DataFrame, hits: DataFrame) -> DataFrame:
    """Rocks that no slug ever hits."""
    return rocks.join(hits.select(F.col("rock").alias("id")), "id", "left_anti")


def hits_of_live_rocks(hits: DataFrame, objects: DataFrame) -> DataFrame:
    """Hits whose rock is among the given objects."""
    live = objects.filter(F.col("type") == "rock").select(F.col("id").alias("rock"))
    return hits.join(live, "rock", "left_semi")


def impacts(
    rocks: DataFrame, hits: DataFrame, as_of: float, strict: bool = False
) -> DataFrame:
    """Unhit rocks whose time at the origin has passed.

    A receding rock's line crosses the origin before its launch; it counts
    unless ``strict``, which also asks for an actual arrival.
    """
    at = impact(track())
    found = unhit_rocks(rocks, hits).select(
        "id",
        F.col("name").alias("rock"),
        "target",
        "fired_s",
        at.t.alias("t"),
        at.pos.r.alias("pos_r"),
        at.pos.theta.alias("pos_theta"),
        at.pos.phi.alias("pos_phi"),
        F.array_join(at.miss, ",").alias("miss"),
    )
    found = found.filter(F.col("t") <= float(as_of))
    return found.filter(F.col("miss").isNull()) if strict else found
