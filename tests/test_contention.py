import brute
import pytest
from bolide.operators import contention, pairing
from pyspark.sql import functions as F
from test_matching import frames


def crowd():
    """Copies on both sides, and classes that meet others at one time."""
    rocks, slugs = brute.scene(6, 6, 8, copies=5)
    for i in range(9):
        rocks.append((1000 + 3 * i, "c", 4, None, 5.0, 0.0, 0.1, 0.0, 0.1, 100.0, 0.0))
        # Another class at the same place, its ids between those of the first.
        rocks.append((1001 + 3 * i, "d", 4, None, 4.0, 0.0, 0.1, 0.0, 0.1, 100.0, 0.0))
        # Fired from the same place at other times and speeds, so that both are there at second 20.
        slugs.append((2000 + 2 * i, "c", None, 10.0, 0.1, 0.1, 10.0))
        slugs.append((2001 + 2 * i, "d", None, 15.0, 0.1, 0.1, 20.0))
    return rocks, slugs


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def pieces(monkeypatch):
    monkeypatch.setattr(pairing, "LIST", 4)
    monkeypatch.setattr(pairing, "TASK_PAIRS", 50)


def test_ranks_and_counts_of_classes(spark, pieces):
    rocks, slugs = crowd()
    r, s = frames(spark, rocks, slugs)
    found = brute.candidates(rocks, slugs)
    pairs = spark.createDataFrame(sorted(found), "rock long, slug long, t double")
    tied = pairs.groupBy("slug", "t").count().filter("count > 9").count()
    assert tied  # two classes of rocks at one time
    assert table(contention.contention_ranks_of(r, s, 500.0)) == table(contention.contention_ranks(pairs))
    assert table(contention.contention_counts_of(r, s, 500.0)) == table(contention.contention_counts(pairs))
    columns = ["rock", "slug", "t", "slug_rank", "rock_rank", "slug_count", "rock_count"]
    got = contention.mutual_first_of(r, s, 500.0)
    assert table(got) == table(contention.mutual_first(pairs).select(*columns))


def test_pairs_are_spread_over_tasks(spark, pieces):
    """One class on either side has nearly all pairs; no task forms more than a share of them."""
    rocks = [(i, "c", 4, None, 5.0, 0.0, 0.1, 0.0, 0.1, 100.0, 0.0) for i in range(30)]
    slugs = [(i, "c", None, 10.0, 0.1, 0.1, 10.0) for i in range(40)]
    r, s = frames(spark, rocks, slugs)
    pairs = pairing.candidate_edges(r, s, budget=100.0)
    per_task = pairs.groupBy(F.spark_partition_id().alias("task")).count()
    assert pairs.count() == 1200
    assert max(x["count"] for x in per_task.collect()) <= 400


def test_repeated_and_missing_ids(spark, pieces):
    rocks = [(i // 2 if i < 8 else None, "c", 4, None, 5.0, 0.0, 0.1, 0.0, 0.1, 100.0, 0.0) for i in range(9)]
    slugs = [(i, "c", None, 10.0, 0.1, 0.1, 10.0) for i in range(4)]
    r, s = frames(spark, rocks, slugs)
    pairs = pairing.candidate_edges(r, s)
    want = table(contention.contention_counts(pairs))
    assert want and table(contention.contention_counts_of(r, s)) == want


@pytest.mark.parametrize("some", [True, False])
def test_empty_sides(spark, some):
    rocks, slugs = crowd()
    r, s = frames(spark, rocks if some else [], [])
    for of in (contention.contention_ranks_of, contention.contention_counts_of, contention.mutual_first_of):
        assert of(r, s).count() == 0
