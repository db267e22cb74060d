"""The twelve-step scenario, fed as micro-batches of changes to the hit keeper."""

import math
import os

import pytest
from bolide.functions.numeric import LIGHT_SPEED as C
from bolide.operators.contention import matching_invariants
from bolide.operators.views import named
from bolide.streaming.maintain import CHANGES, HitKeeper

PI = math.pi
# Seconds of the launch instant within its day; the epoch is that day's midnight.
T0 = 43200.0
MIDNIGHT = 1704067200.0


def rock(id_, name, params, fired=T0, mass=4, seq=0, op="upsert"):
    m_t, b_t, m_p, b_p, r_0, v = map(float, params)
    return (seq, "rock", op, id_, name, mass, None, fired, m_t, b_t, m_p, b_p, r_0, v, None, None)


def slug(id_, name, theta, phi, v, seq=0, op="upsert"):
    none = (None,) * 5
    return (seq, "slug", op, id_, name, None, None, T0, *none, float(v), float(theta), float(phi))


CERES = (0, 0, 0, 0, 10 * C, 0)
EROS = (0, PI, 0, PI, 10 * C, 0)
SEED = [
    rock(1, "ceres", CERES, fired=0.0, mass=9),
    rock(2, "eros", EROS),
    rock(3, "tycho", (0.1, PI, 0, PI, 10 * C, -C)),
    rock(4, "ganymede", (0, PI / 4, 0, PI / 4, 10 * C, 0)),
    rock(5, "luna", (0, 3, 0, 3, 3600 * C, 0)),
    slug(1, "100 @ ceres (hit)", 0, 0, C),
    slug(2, "200 @ ceres (miss)", 0, 0, 0),
    slug(3, "300 @ ceres (miss)", 1, 1, C),
    slug(4, "400 @ eros (hit)", PI + 6 * PI, PI + 6 * PI, C),
    slug(5, "500 @ tycho (miss - late)", 0.1 * 20 / 3 + PI, PI, C / 2),
    slug(6, "600 @ tycho (hit)", 0.1 * 5 + PI, PI, C),
    slug(7, "700 @ ceres (miss - late)", 0, 0, 0.1 * C),
]
VENUS = (0, 3, 0, 3, 1800 * C, 0)
G = PI / 4

# (changes, number of hits, expected slug prefix per rock; None: no hit)
STEPS = [
    (SEED, 4, {"ceres": "100", "ceres I": "700", "tycho": "600", "eros": "400"}),
    ([slug(8, "800 @ luna (hit)", 3, 3, C)], 5, {"luna": "800"}),
    ([slug(9, "900 @ ganymede (miss)", G, G, 0)], 5, {"ganymede": None}),
    ([slug(9, "900 @ ganymede (hit)", G, G, C)], 6, {"ganymede": "900"}),
    ([slug(9, "", 0, 0, 0, op="delete")], 5, {"ganymede": None}),
    ([slug(7, "700 @ ceres (hit)", 0, 0, 100 * C)], 5, {"ceres": "700", "ceres I": "100"}),
    ([rock(1, "ceres", CERES, fired=0.0, mass=1)], 4, {"ceres": "700", "ceres I": None}),
    ([rock(1, "ceres", CERES, fired=0.0, mass=4)], 5, {"ceres": "700"}),
    ([rock(2, "eros", (0, PI + PI / 8, 0, PI, 10 * C, 0))], 4, {"eros": None}),
    ([rock(2, "eros", EROS)], 5, {"eros": "400"}),
    ([rock(6, "venus", VENUS)], 5, {"luna": None, "venus": "800"}),
    ([rock(6, "venus", VENUS, op="delete")], 5, {"luna": "800"}),
]


# Steps that arrive together; the state is checked after each group. With
# EVERY_STEP set, each step is a micro-batch of its own.
GROUPS = [[0], [1, 2, 3], [4, 5], [6], [7, 8], [9, 10], [11]]
if os.environ.get("EVERY_STEP"):
    GROUPS = [[i] for i in range(len(STEPS))]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    # A dozen rows per table: one partition and interpreted plans are quickest.
    tiny = {
        "spark.sql.shuffle.partitions": "1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.codegen.wholeStage": "false",
    }
    before = {k: spark.conf.get(k) for k in tiny}
    for k, v in tiny.items():
        spark.conf.set(k, v)
    yield _run_steps(spark, tmp_path_factory)
    for k, v in before.items():
        spark.conf.set(k, v)


def _run_steps(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("keeper"))
    keeper = HitKeeper(spark, folder, epoch_s=MIDNIGHT, buckets=2, compact_every=4)
    states = {}
    for batch, group in enumerate(GROUPS):
        changes = [(step, *row[1:]) for step in group for row in STEPS[step][0]]
        keeper(spark.createDataFrame(changes, CHANGES), batch)
        tables = {n: keeper.tables.current(n) for n in ("rocks", "slugs", "hits", "fragments")}
        everyone = tables["rocks"].select("id", "name").unionByName(
            tables["fragments"].select("id", "name")
        )
        pairs = named(tables["hits"], everyone, tables["slugs"]).collect()
        names = [r.name for r in everyone.collect()]
        check = matching_invariants(tables["hits"]).first()
        feed = keeper.feed().collect()
        states[group[-1]] = ({r.rock_name: r.slug_name for r in pairs}, names, check, feed)
    return states


@pytest.mark.parametrize("step", [g[-1] for g in GROUPS])
def test_step(kept, step):
    hits, names, check, _ = kept[step]
    _, count, expected = STEPS[step]
    assert (check.hits, check.rocks, check.slugs) == (count, count, count) and check.ok
    for name, prefix in expected.items():
        if prefix is None:
            assert name not in hits
        else:
            assert hits[name].startswith(prefix)


def test_family_of_eros(kept):
    assert sum(n.startswith("eros") for n in kept[8][1]) == 1
    assert sum(n.startswith("eros") for n in kept[11][1]) == 2


def test_feed_has_only_differences(kept):
    assert sorted(f.op for f in kept[0][3]) == ["add"] * 4
    assert sorted({f.op for f in kept[5][3]}) == ["add", "retract"]
    assert sorted({f.op for f in kept[11][3]}) == ["add", "retract"]
