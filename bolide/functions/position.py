"""Positions of rocks (linear in r, theta, phi) and slugs (fixed bearing).

A ``Track`` names the columns of a rock's launch, a ``Shot`` those of a slug.
Times are seconds since the data set's epoch, as doubles.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from bolide.functions.numeric import (
    LIGHT_SPEED,
    PI,
    TWO_PI,
    hundredths,
    round_away,
    wrap_angle,
)

TRACK_FIELDS = ("fired_s", "m_theta", "b_theta", "m_phi", "b_phi", "r_0", "v")
SHOT_FIELDS = ("fired_s", "theta", "phi", "v")


class Track(NamedTuple):
    fired_s: Column
    m_theta: Column
    b_theta: Column
    m_phi: Column
    b_phi: Column
    r_0: Column
    v: Column


class Shot(NamedTuple):
    fired_s: Column
    theta: Column
    phi: Column
    v: Column


class Pos(NamedTuple):
    r: Column
    theta: Column
    phi: Column


class Cartesian(NamedTuple):
    x: Column
    y: Column
    z: Column


def track(prefix: str = "") -> Track:
    return Track(*[F.col(prefix + name) for name in TRACK_FIELDS])


def shot(prefix: str = "") -> Shot:
    return Shot(*[F.col(prefix + name) for name in SHOT_FIELDS])


def track_pos(rock: Track, t: Column, delay: bool = False) -> Pos:
    """Position at ``t``; with ``delay``, where the light seen at ``t`` left it.

    The delay uses the distance at ``t`` once, without iterating.
    """
    age = t - rock.fired_s
    if delay:
        age = age - (rock.r_0 + rock.v * age) / F.lit(LIGHT_SPEED)
    return Pos(
        rock.r_0 + rock.v * age,
        rock.m_theta * age + rock.b_theta,
        rock.m_phi * age + rock.b_phi,
    )


def shot_pos(slug: Shot, t: Column, delay: bool = False) -> Pos:
    age = t - slug.fired_s
    if delay:
        age = age - slug.v * age / F.lit(LIGHT_SPEED)
    return Pos(slug.v * age, slug.theta, slug.phi)


def to_cartesian(pos: Pos) -> Cartesian:
    return Cartesian(
        pos.r * F.sin(pos.phi) * F.cos(pos.theta),
        pos.r * F.sin(pos.phi) * F.sin(pos.theta),
        pos.r * F.cos(pos.phi),
    )


def to_spherical(c: Cartesian) -> Pos:
    """Inverse of ``to_cartesian``; phi is null at the origin."""
    r = F.sqrt(c.x * c.x + c.y * c.y + c.z * c.z)
    ratio = c.z / F.when(r > 0, r)
    return Pos(r, F.atan2(c.y, c.x), F.acos(ratio))


def octant(c: Cartesian) -> Column:
    """Octant 1..8 by the signs of x, y, z; zero counts as positive."""
    around = (
        F.when((c.x >= 0) & (c.y >= 0), 1)
        .when((c.x < 0) & (c.y >= 0), 2)
        .when((c.x < 0) & (c.y < 0), 3)
        .when((c.x >= 0) & (c.y < 0), 4)
    )
    below = F.when(c.z >= 0, 0).when(c.z < 0, 4)
    return around + below


def normalize(pos: Pos) -> Pos:
    return Pos(pos.r, wrap_angle(pos.theta, TWO_PI), wrap_angle(pos.phi, PI))


def normalize_track(rock: Track) -> Track:
    return rock._replace(
        b_theta=wrap_angle(rock.b_theta, TWO_PI), b_phi=wrap_angle(rock.b_phi, PI)
    )


def normalize_shot(slug: Shot) -> Shot:
    return slug._replace(
        theta=wrap_angle(slug.theta, TWO_PI), phi=wrap_angle(slug.phi, PI)
    )


def round_pos(pos: Pos, digits: int) -> Pos:
    return Pos(*[round_away(part, digits) for part in pos])


def round_track(rock: Track, digits: int) -> Track:
    """Round the six launch parameters, not the launch time."""
    parts = [round_away(part, digits) for part in rock[1:]]
    return Track(rock.fired_s, *parts)


def round_shot(slug: Shot, digits: int) -> Shot:
    return Shot(slug.fired_s, *[round_away(part, digits) for part in slug[1:]])


def theta_bin(theta: Column) -> Column:
    """Bearing bin compared by encounters: normalised hundredths of a radian."""
    return hundredths(wrap_angle(theta, TWO_PI))


def phi_bin(phi: Column) -> Column:
    return hundredths(wrap_angle(phi, PI))


def launch_from_impact(t_impact: Column, speed: float = LIGHT_SPEED / 2) -> dict[str, Column]:
    """Inbound launch parameters that reach the origin after ``t_impact`` seconds."""
    return {"v": F.lit(-speed), "r_0": F.lit(speed) * t_impact}


def impact_age(r_0: Column, v: Column) -> Column:
    """Seconds from launch to the origin; null at rest."""
    return -r_0 / F.when(v != 0, v)
