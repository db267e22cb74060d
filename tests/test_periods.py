"""Overlap joins and recorded states against plain loops over all pairs and instants."""

import datetime as dt
import random

import pytest
from bolide.operators import recorded
from bolide.plans import periods
from pyspark.sql import functions as F

SPAN = "valid_from double, valid_to double"


def _bins(width):
    return lambda at: F.floor(at / width)


def _overlaps(left, right):
    far = float("inf")
    out = []
    end = lambda t: far if t is None else t
    for k, a, f, t in left:
        for q, b, g, u in right:
            low, high = max(f, g), min(end(t), end(u))
            if k is not None and k == q and low < high:
                out.append((k, a, b, low, None if high == far else high))
    return sorted(out, key=repr)


def _some(rng, n, mark):
    rows = []
    for i in range(n):
        begin = rng.choice([rng.uniform(-50, 900), float(rng.randint(-5, 5) * 10)])
        length = rng.choice([0.0, 0.5, 10.0, rng.uniform(0, 700), None])
        key = rng.choice([None, 1, 1, 1, 2, 3])
        rows.append((key, f"{mark}{i % (n - 3)}", begin, None if length is None else begin + length))
    return rows + rows[:2]


@pytest.mark.parametrize("width", [0.5, 7.0, 5000.0])
def test_overlaps_equal_all_pairs(spark, width):
    rng = random.Random(3)
    left, right = _some(rng, 60, "a"), _some(rng, 50, "b")
    got = periods.overlap_join(
        spark.createDataFrame(left, f"k long, a string, {SPAN}"),
        spark.createDataFrame(right, f"k long, b string, {SPAN}"),
        ["k"],
        _bins(width),
    ).select("k", "a", "b", "valid_from", "valid_to")
    want = _overlaps(left, right)
    assert len(want) > 300
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_overlaps_of_empty_and_clashing_tables(spark):
    some = spark.createDataFrame([(1, "a", 0.0, None)], f"k long, a string, {SPAN}")
    none = spark.createDataFrame([], f"k long, b string, {SPAN}")
    for left, right in ((some, none), (none, some), (none, none.withColumnRenamed("b", "c"))):
        assert periods.overlap_join(left, right, ["k"], _bins(1.0)).count() == 0
    with pytest.raises(ValueError, match="a"):
        periods.overlap_join(some, some, ["k"], _bins(1.0))


def test_opening_versions_hold_until_the_first_change(spark):
    day = lambda n: dt.datetime(2000, 1, n)
    rows = [(1, day(3), 0, 5, False), (1, day(5), 0, 0, True), (1, day(9), 1, 6, False), (1, day(9), 2, 7, False)]
    feed = spark.createDataFrame(rows, "rock long, changed_at timestamp_ntz, seq long, mass long, gone boolean")
    table = spark.createDataFrame([(1, 4), (2, 8)], "rock long, mass long")
    start = F.lit("2000-01-01").cast("timestamp_ntz")
    got = recorded.recorded_periods(table, feed, "rock", start)
    before = dt.datetime(1999, 12, 31, 23)
    assert sorted((tuple(r) for r in got.select("rock", "mass", "valid_from", "valid_to").collect()), key=repr) == sorted(
        [(1, 4, before, day(3)), (1, 5, day(3), day(5)), (1, 7, day(9), None), (2, 8, before, None)], key=repr
    )


def test_no_side_is_broadcast(spark, tmp_path):
    """Cut periods are many times the file they come from, however small that looks."""
    sides = []
    for name in ("a", "b"):
        spark.createDataFrame([(1, "x", 0.0, 9.0)], f"k long, {name} string, {SPAN}").write.parquet(f"{tmp_path}/{name}")
        sides.append(spark.read.parquet(f"{tmp_path}/{name}"))
    plan = periods.overlap_join(*sides, ["k"], _bins(7.0))._jdf
    assert "BroadcastHashJoin" not in plan.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("crowd", [0, 40, 1000])
def test_crowded_keys_and_others_meet_alike(spark, crowd):
    rng = random.Random(4)
    left, right = _some(rng, 60, "a"), _some(rng, 50, "b")
    got = periods.overlap_join(
        spark.createDataFrame(left, f"k long, a string, {SPAN}"),
        spark.createDataFrame(right, f"k long, b string, {SPAN}"),
        ["k"],
        _bins(7.0),
        crowd=crowd,
    )
    assert got.columns == ["k", "b", "a", "valid_from", "valid_to"]
    rows = got.select("k", "a", "b", "valid_from", "valid_to").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == _overlaps(left, right)


def test_rows_of_ordinary_keys_are_moved_once(spark):
    """Cut into nodes, a row was shuffled some ten times, which filled the disk."""
    left = spark.createDataFrame([(k % 50, k, float(k), float(k + 40)) for k in range(600)], f"k long, a long, {SPAN}")
    right = spark.createDataFrame([(k % 50, k, float(k), None) for k in range(600)], f"k long, b long, {SPAN}")
    plan = periods.overlap_join(left, right, ["k"], _bins(1.0))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert plan.count("Exchange hashpartitioning") == 2
