import math

import pytest
from bolide.functions import encounter as E
from bolide.functions import numeric as N
from bolide.functions import position as P
from pyspark.sql import functions as F


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return list(row)


def test_rounding_and_remainders(spark):
    lit = F.lit
    got = one(
        spark,
        N.round_away(lit(1.005), 2),
        N.round_away(lit(-2.5), 0),
        N.round_away(lit(-0.001), 2),
        N.hundredths(lit(-0.125)),
        N.wrap_angle(lit(-7.5), 2.0),
        N.round_away(lit(1.5e300), 2),
    )
    assert got == [1.0, -3.0, 0.0, -13.0, -1.5, 1.5e300]
    assert math.copysign(1, got[2]) == 1


def test_roman_and_halves(spark):
    got = one(spark, *[N.roman(F.lit(n)) for n in (1, 4, 9, 14, 1994, 3999, 0, 4000)])
    assert got == ["I", "IV", "IX", "XIV", "MCMXCIV", "MMMCMXCIX", None, None]
    assert one(spark, *[N.halved(F.lit(n)) for n in (9, 4, 1)]) == [4, 2, 0]


def test_times(spark):
    t0 = F.lit("2024-01-01 00:00:00")
    t = N.at_seconds(t0, F.lit(90061.25))
    assert one(spark, N.elapsed_seconds(t, t0), N.seconds_of_day(F.lit(90061.25))) == [
        90061.25,
        3661.25,
    ]


def test_eta(spark):
    got = one(
        spark,
        N.eta_signed(F.lit(10.0), F.lit(-2.0)),
        N.eta_signed(F.lit(10.0), F.lit(0.0)),
        N.time_to_impact(F.lit(10.0), F.lit(-2.0)),
        N.time_to_impact(F.lit(10.0), F.lit(2.0)),
        N.is_close(F.lit(1.0), F.lit(1.0 + 1e-12)),
        N.is_true(F.lit(None).cast("boolean")),
    )
    assert got == [-5.0, math.inf, 5.0, math.inf, True, False]


@pytest.mark.parametrize("octant", range(1, 9))
def test_octants(spark, octant):
    x = -1.0 if octant in (2, 3, 6, 7) else 1.0
    y = -1.0 if octant in (3, 4, 7, 8) else 1.0
    z = 1.0 if octant <= 4 else -1.0
    c = P.Cartesian(F.lit(x), F.lit(y), F.lit(z))
    back = P.to_cartesian(P.to_spherical(c))
    got = one(spark, P.octant(c), *back)
    assert got[0] == octant
    assert got[1:] == pytest.approx([x, y, z])


def test_octant_edges(spark):
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    assert one(
        spark, P.octant(P.Cartesian(zero, zero, zero)), P.octant(P.Cartesian(none, zero, zero))
    ) == [1, None]


def rock(**kw):
    base = dict(fired_s=0, m_theta=0, b_theta=0, m_phi=0, b_phi=0, r_0=0, v=0)
    return P.Track(**{k: F.lit(float(v)) for k, v in {**base, **kw}.items()})


def slug(**kw):
    base = dict(fired_s=0, theta=0, phi=0, v=0)
    return P.Shot(**{k: F.lit(float(v)) for k, v in {**base, **kw}.items()})


@pytest.mark.parametrize(
    "r, s, t, miss",
    [
        (dict(r_0=10), dict(v=2), 5.0, None),
        (dict(r_0=10), dict(v=0), None, ["r"]),
        (dict(r_0=10, v=2), dict(v=1), -10.0, ["r"]),
        (dict(r_0=10), dict(v=2, theta=1), 5.0, ["theta"]),
        (dict(r_0=10), dict(v=2, phi=1), 5.0, ["phi"]),
        (dict(r_0=10), dict(v=2, theta=1, phi=1), 5.0, ["theta", "phi"]),
        # The seam: one turn more is the same bearing, just below it is not.
        (dict(r_0=10), dict(v=2, theta=2 * math.pi), 5.0, None),
        (dict(r_0=10), dict(v=2, theta=-0.01), 5.0, ["theta"]),
        (dict(r_0=10), dict(v=2, theta=2 * math.pi - 0.001), 5.0, ["theta"]),
        # A slug at rest on the right bearing meets a rock at the origin.
        (dict(r_0=10, v=-1), dict(v=0), 10.0, None),
        (dict(r_0=10, fired_s=100), dict(v=2), 5.0, ["r"]),
    ],
)
def test_collide(spark, r, s, t, miss):
    e = E.collide(rock(**r), slug(**s))
    assert one(spark, e.t, e.miss) == [t, miss]


def test_impact(spark):
    inbound, still, receding = rock(r_0=10, v=-2), rock(r_0=10), rock(r_0=10, v=2)
    found = [E.impact(x) for x in (inbound, still, receding)]
    assert one(spark, *[e.t for e in found]) == [5.0, None, -5.0]
    assert one(spark, *[e.miss for e in found]) == [None, ["r"], ["r"]]


def test_light_delay(spark):
    far = rock(r_0=N.LIGHT_SPEED * 10, m_theta=0.1)
    now, seen = P.track_pos(far, F.lit(30.0)), P.track_pos(far, F.lit(30.0), delay=True)
    assert one(spark, now.theta, seen.theta) == pytest.approx([3.0, 2.0])


def test_fragment_ids_of_large_roots_fail(spark):
    import pytest
    from bolide.operators.fragments import fragment_id
    from pyspark.sql import functions as F

    ids = lambda n: spark.range(n, n + 1).select(fragment_id(F.col("id"), F.lit(1)).alias("i"))
    assert ids(7).first().i == 10**12 + 7
    with pytest.raises(Exception, match="outside"):
        ids(10**12).collect()
