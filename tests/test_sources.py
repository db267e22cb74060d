import pytest
from bolide.operators import history, names, quality, solve, views
from bolide.plans import skew
from bolide.sources import records, tables
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def test_records_and_defaults(spark, tmp_path):
    df = records.rock_records(
        spark,
        [(1, "a", None, None, None, None), (2, "b", 9, "x", None, (0.0, 1.0, 0.0, 2.0, 3.0, 4.0))],
        "2024-01-01 00:01:00",
    )
    flat = {r.id: r for r in records.flat_rocks(df, EPOCH).collect()}
    assert (flat[1].mass, flat[1].fired_s, flat[1].r_0) == (4, 60.0, 0.0)
    assert (flat[2].mass, flat[2].b_theta, flat[2].v) == (9, 1.0, 4.0)
    back = records.nested(records.flat_rocks(df, EPOCH), EPOCH, views.ROCK_PARAMS)
    assert back.filter("id = 2").first().params.b_phi == 2.0
    moved = records.set_param(df, F.col("name") == "b", "v", F.lit(7.0))
    assert [r.params.v for r in moved.orderBy("id").collect()] == [0.0, 7.0]
    records.write_json(df, str(tmp_path / "json"))
    again = records.read_json(spark, str(tmp_path / "json"), records.ROCK_SCHEMA)
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))


def test_names(spark, tmp_path):
    src = tmp_path / "list.txt"
    src.write_text("\n".join(["header"] * 13 + ["Guido van Rossum", "Sunny K", "'t Hooft", "Aahz"]))
    read = names.read_names(spark, str(src))
    short = [r[0] for r in read.select(names.short_name(F.col("name"))).collect()]
    assert short[0].startswith("Gv Rossum ") and short[0].split()[-1].isdigit()
    assert short[1] == "Sunny K"
    assert short[2].startswith("Hooft ") and short[3].startswith("Aahz ")
    names.write_names(read, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_requests(spark):
    bodies = ['{"name":"a","theta":"1","phi":"2","fired":"12:00:30"}', '{"theta":"x","phi":"2"}', "no json"]
    now = F.lit("2024-06-01 10:00:00").cast("timestamp")
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "event_id long, body string")
    parsed = quality.parse_requests(df).withColumn("ts", now)
    at = quality.launch_time(F.col("fired"), now, "Europe/Berlin")
    offset = (F.unix_micros(at) - F.unix_micros(now)) / 1e6
    got = quality.validated(parsed, ["theta", "phi"], offset, F.col("malformed"))
    rows = {r.event_id: r for r in got.collect()}
    assert rows[0].reject_reason is None and rows[0].theta_rad == 1.0
    assert rows[1].reject_reason == "bad angle" and rows[1].name == "shot #10"
    assert rows[2].reject_reason == "malformed"
    assert quality.accepted(got).count() == 1


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (2, 1.0, None)], "id long, v double, n string")
    assert {(r.id, r.column) for r in quality.constraint_violations(df, ["v", "n"]).collect()} == {
        (2, "v"),
        (2, "n"),
    }
    good, bad = quality.quarantine(df, ["v", "n"])
    assert (good.count(), bad.count()) == (1, 2)
    assert [r.id for r in quality.repeated_keys(df, ["id"]).collect()] == [2]
    feed = spark.createDataFrame([(1, 1), (2, 3), (None, 4)], "old_id long, new_id long")
    assert quality.changed_ids(feed).count() == 1


def test_octant_argument(spark):
    with pytest.raises(ValueError):
        views.observe_octant(spark.range(1), 9)


def test_skew_helpers_match_plain_windows(spark):
    """One key has nearly all rows; chunked answers equal the plain windows."""
    rows = [(0 if i % 10 else 1, float((i * 37) % 200), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t double, i long")
    df.createOrReplaceTempView("skewed")
    chunk = F.floor(F.col("t") / 16)
    got = skew.ranked(df, ["k"], ["t", "i"], chunk, "n")
    want = spark.sql("select *, cast(row_number() over (partition by k order by t, i) as long) n from skewed")
    assert got.exceptAll(want).count() == 0 and got.count() == 400
    got = skew.with_next(df, ["k"], ["t", "i"], chunk, "t", "later")
    want = spark.sql("select *, lead(t) over (partition by k order by t, i) later from skewed")
    assert got.exceptAll(want).count() == 0 and got.count() == 400


def test_history_periods(spark):
    feed = spark.createDataFrame(
        [(1, "2024-01-01", 1, "a"), (1, "2024-03-01", 2, "b"), (2, "2024-02-01", 3, "c")],
        "obj_id long, d string, seq long, status string",
    ).select("obj_id", F.to_timestamp("d").alias("changed_at"), "seq", "status")
    when = F.lit("2024-02-15").cast("timestamp")
    spans = history.history_intervals(feed)
    assert {r.status for r in history.current_at(spans, when).collect()} == {"a", "c"}
    assert {r.status for r in history.history_as_of(feed, when).collect()} == {"a", "c"}


def test_sample_fit_recover(spark):
    rocks = tables.rocks(spark, "/root/testdata/sf0.001")
    fits = solve.two_point_fit(tables.observations(rocks)).filter("pair_no = 0")
    both = rocks.alias("r").join(fits.alias("f"), "name")
    off = sum((F.abs(F.col(f"r.{c}") - F.col(f"f.{c}")) for c in ("v", "r_0", "m_theta", "b_phi")), F.lit(0.0))
    assert both.filter(off > 1e-6).count() == 0 and both.filter("consistent").count() == 10


def test_headers_of_several_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("".join(f"head {k}\n" for k in range(3)) + f"name {i}\n\nlast {i}\n")
    got = {r.name for r in names.read_names(spark, str(tmp_path), 3).collect()}
    assert got == {f"{word} {i}" for word in ("name", "last") for i in range(3)}
