"""Plain-Python answers for small inputs."""

from __future__ import annotations

import math
import random

ROCK_SCHEMA = (
    "id long, name string, mass long, target string, fired_s double, m_theta double,"
    " b_theta double, m_phi double, b_phi double, r_0 double, v double"
)
SLUG_SCHEMA = "id long, name string, target string, fired_s double, theta double, phi double, v double"


def bin100(x: float) -> float:
    return math.copysign(math.floor(abs(x) * 100 + 0.5), x) + 0.0


def theta_bin(x: float) -> float:
    return bin100(math.fmod(x, 2 * math.pi))


def phi_bin(x: float) -> float:
    return bin100(math.fmod(x, math.pi))


def meeting(rock: tuple, slug: tuple):
    _, _, _, _, rf, mt, bt, mp, bp, r0, rv = rock
    _, _, _, sf, th, ph, sv = slug
    if sv == rv:
        return None
    t = sf + (r0 + rv * (sf - rf)) / (sv - rv)
    if t < rf or t < sf:
        return None
    age = t - rf
    if theta_bin(mt * age + bt) != theta_bin(th) or phi_bin(mp * age + bp) != phi_bin(ph):
        return None
    return t


def candidates(rocks: list[tuple], slugs: list[tuple]) -> set[tuple]:
    out = set()
    for r in rocks:
        for s in slugs:
            t = meeting(r, s)
            if t is not None:
                out.add((r[0], s[0], t))
    return out


def in_order(pairs) -> set[tuple]:
    rocks, slugs, out = set(), set(), set()
    for r, s, t in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if r not in rocks and s not in slugs:
            rocks.add(r)
            slugs.add(s)
            out.add((r, s, t))
    return out


def first_per_rock(pairs) -> set[tuple]:
    best: dict = {}
    for r, s, t in pairs:
        if r not in best or (t, s) < best[r]:
            best[r] = (t, s)
    return {(r, s, t) for r, (t, s) in best.items()}


def scene(seed: int, n_rocks: int = 40, n_slugs: int = 60, copies: int = 1):
    """Rocks and slugs on few bearings: still, turning, receding and inward ones."""
    rng = random.Random(seed)
    rocks, slugs = [], []
    for _ in range(n_rocks):
        launch = (
            float(rng.randrange(0, 30)),
            rng.choice([0.0, 0.0, 0.01, -0.02, 0.5]),
            0.1 + rng.randrange(3) / 4,
            rng.choice([0.0, 0.0, 0.0, 0.01]),
            0.1 + rng.randrange(2) * 0.75,
            float(rng.choice([50, 100, 200, 400])),
            float(rng.choice([-3, -1, 0, 0, 2])),
        )
        for _ in range(copies):
            rocks.append((len(rocks) + 1, f"r{len(rocks)}", 4, None, *launch))
    for _ in range(n_slugs):
        launch = (
            float(rng.randrange(0, 60)),
            0.1 + rng.randrange(3) / 4,
            0.1 + rng.randrange(2) * 0.75,
            float(rng.choice([-2, 0, 1, 2, 5, 10, 10, 20, 1000])),
        )
        for _ in range(copies):
            slugs.append((len(slugs) + 1, f"s{len(slugs)}", None, *launch))
    rng.shuffle(rocks)
    rng.shuffle(slugs)
    return rocks, slugs
