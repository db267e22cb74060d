import pytest
from bolide.operators.history import history_intervals
from bolide.plans.skew import as_of_join, with_next
from pyspark.sql import functions as F


def test_as_of_join_keeps_every_probe(spark):
    probes = spark.createDataFrame(
        [(1, "a", 5.0), (2, None, 5.0), (3, "a", None), (4, "b", 1.0)], "id long, k string, at double"
    )
    versions = spark.createDataFrame([("a", 2.0, 1, "x")], "k string, since double, seq int, v string")
    out = as_of_join(probes, versions, "k", "at", "since", "seq", ["v"], lambda c: F.floor(c / 10))
    assert {r["id"]: r["v"] for r in out.collect()} == {1: "x", 2: None, 3: None, 4: None}


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_rows_that_look_ahead_are_dealt_out_once(spark, no_broadcast):
    feed = spark.range(500).selectExpr(
        "if(id % 6 = 0, null, id % 6) as k", "timestamp_seconds(id * 99991) as at", "id as seq", "id % 3 as v"
    )
    chunk = F.month("at")
    plan = with_next(feed, ["k"], ["at", "seq"], F.year("at") * 12 + chunk, "at", "later")._jdf.queryExecution()
    # The rows; of the small rows per chunk the first values, the order by key, and the way back to the rows.
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 4
    spans = history_intervals(feed, "k", "at", "seq")
    assert spans.columns == ["k", "seq", "v", "valid_from", "valid_to"]
    assert "min_by" not in spans._jdf.queryExecution().executedPlan().toString()
    rows, want = sorted(feed.collect(), key=lambda r: r["at"]), {}
    for i, r in enumerate(rows):
        want[r["seq"]] = next((x["at"] for x in rows[i + 1 :] if x["k"] == r["k"]), None)
    assert {r["seq"]: r["valid_to"] for r in spans.collect()} == want
