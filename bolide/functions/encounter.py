"""Closed-form encounters: rock with slug, and rock with the origin."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from bolide.functions.numeric import is_true, round_away
from bolide.functions.position import (
    Pos,
    Shot,
    Track,
    phi_bin,
    shot_pos,
    theta_bin,
    track_pos,
)


class Encounter(NamedTuple):
    """When and where two tracks meet, how far apart, and why not."""

    t: Column
    pos: Pos
    mdiff: Pos
    miss: Column


def meeting_time(rock: Track, slug: Shot) -> Column:
    """Time at which both have the same r; null at equal speed.

    Solved relative to the slug's launch, which keeps large epochs out of the
    products and so keeps the digits.
    """
    closing = F.when(slug.v != rock.v, slug.v - rock.v)
    gap = rock.r_0 + rock.v * (slug.fired_s - rock.fired_s)
    return slug.fired_s + gap / closing


def in_flight(t: Column, rock: Track, slug: Shot) -> Column:
    """Both were launched by ``t``; false when there is no ``t``."""
    return is_true((t >= rock.fired_s) & (t >= slug.fired_s))


def same_bearing(t: Column, rock: Track, slug: Shot) -> Column:
    at = track_pos(rock, t)
    return (theta_bin(at.theta) == theta_bin(slug.theta)) & (
        phi_bin(at.phi) == phi_bin(slug.phi)
    )


def is_hit(t: Column, rock: Track, slug: Shot) -> Column:
    """The encounter at ``t`` has no miss reason."""
    return in_flight(t, rock, slug) & same_bearing(t, rock, slug)


def collide(rock: Track, slug: Shot, t: Column | None = None) -> Encounter:
    """Full verdict of one pair. ``miss`` is null exactly for a hit.

    ``r`` stands alone (no common r in flight); otherwise theta and phi are
    compared in whole hundredths after normalising.
    """
    if t is None:
        t = meeting_time(rock, slug)
    flying = in_flight(t, rock, slug)
    rock_at, slug_at = track_pos(rock, t), shot_pos(slug, t)
    rock_r, slug_r = round_away(rock_at.r, 2), round_away(slug_at.r, 2)
    rock_th, slug_th = theta_bin(rock_at.theta), theta_bin(slug_at.theta)
    rock_ph, slug_ph = phi_bin(rock_at.phi), phi_bin(slug_at.phi)
    off_th, off_ph = rock_th != slug_th, rock_ph != slug_ph
    theta, phi = F.lit("theta"), F.lit("phi")
    miss = (
        F.when(~flying, F.array(F.lit("r")))
        .when(off_th & off_ph, F.array(theta, phi))
        .when(off_th, F.array(theta))
        .when(off_ph, F.array(phi))
    )
    pos = Pos(
        F.when(flying, slug_r),
        F.when(flying, slug_th / F.lit(100.0)),
        F.when(flying, slug_ph / F.lit(100.0)),
    )
    mdiff = Pos(
        F.when(flying, round_away(rock_r - slug_r, 2)),
        F.when(flying, (rock_th - slug_th) / F.lit(100.0)),
        F.when(flying, (rock_ph - slug_ph) / F.lit(100.0)),
    )
    return Encounter(t, pos, mdiff, miss)


def impact(rock: Track) -> Encounter:
    """When and where a rock reaches the origin; at rest or receding it misses r."""
    t = rock.fired_s + rock.r_0 / -F.when(rock.v != 0, rock.v)
    arrives = is_true(t >= rock.fired_s)
    at = track_pos(rock, t)
    pos = Pos(*[F.when(arrives, part) for part in at])
    zero = F.lit(0.0)
    return Encounter(
        t, pos, Pos(pos.r, zero, zero), F.when(~arrives, F.array(F.lit("r")))
    )


def encounter_columns(e: Encounter) -> list[Column]:
    """Flat columns of an encounter; miss reasons joined by commas."""
    return [
        e.t.alias("t"),
        e.pos.r.alias("pos_r"),
        e.pos.theta.alias("pos_theta"),
        e.pos.phi.alias("pos_phi"),
        e.mdiff.r.alias("mdiff_r"),
        e.mdiff.theta.alias("mdiff_theta"),
        e.mdiff.phi.alias("mdiff_phi"),
        F.array_join(e.miss, ",").alias("miss"),
    ]


def encounter_struct(e: Encounter) -> Column:
    """Nested form of an encounter, as stored in a collisions table."""

    def spherical(p: Pos) -> Column:
        return F.struct(p.r.alias("r"), p.theta.alias("theta"), p.phi.alias("phi"))

    return F.struct(
        e.t.alias("t"),
        spherical(e.pos).alias("pos"),
        spherical(e.mdiff).alias("mdiff"),
        e.miss.alias("miss"),
    )
