import random

import brute
import pytest
from bolide.operators import fragments, matching, pairing
from bolide.plans import components
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frames(spark, rocks, slugs):
    return (
        spark.createDataFrame(rocks, brute.ROCK_SCHEMA),
        spark.createDataFrame(slugs, brute.SLUG_SCHEMA),
    )


def rows(df):
    return {(r.rock, r.slug, r.t) for r in df.collect()}


def match_by_fold(pairs: DataFrame) -> DataFrame:
    """Literal running aggregate over (t, rock, slug), for one small set of pairs."""
    entry = F.struct("t", "rock", "slug")
    start = F.expr(
        "named_struct('hits', cast(array() as array<struct<t:double,rock:bigint,slug:bigint>>))"
    )

    def take(acc, x):
        taken = F.exists(
            acc["hits"], lambda h: (h["rock"] == x["rock"]) | (h["slug"] == x["slug"])
        )
        return F.struct(
            F.when(taken, acc["hits"]).otherwise(F.array_append(acc["hits"], x)).alias("hits")
        )

    ordered = F.sort_array(F.collect_list(entry))
    return (
        pairs.agg(F.aggregate(ordered, start, take).alias("_acc"))
        .select(F.explode("_acc.hits").alias("h"))
        .select("h.rock", "h.slug", "h.t")
    )


def test_rest_in_one_task(spark):
    rocks, slugs = brute.scene(1, 40, 60)
    pairs = brute.candidates(rocks, slugs)
    r, s = frames(spark, rocks, slugs)
    assert rows(pairing.candidate_edges(r, s)) == pairs
    assert rows(matching.ordered_matching(r, s)) == brute.in_order(pairs)
    assert rows(matching.first_hit_per_rock(r, s)) == brute.first_per_rock(pairs)


def test_slices_and_grid(spark, monkeypatch):
    """A tiny budget cuts time into slices and brings in the radius grid."""
    rocks, slugs = brute.scene(2, 30, 40)
    pairs = brute.candidates(rocks, slugs)
    r, s = frames(spark, rocks, slugs)
    cuts = []
    plain = pairing.cut

    def counted(*args):
        cuts.append(args)
        return plain(*args)

    monkeypatch.setattr(matching, "cut", counted)
    got = rows(matching.ordered_matching(r, s, budget=330.0))
    assert got == brute.in_order(pairs)
    assert cuts


@pytest.mark.parametrize("class_tail", [0, 1000])
def test_rounds_with_copies(spark, monkeypatch, class_tail):
    """A third of both sides are copies of one launch; no round may take them singly."""
    rocks, slugs = brute.scene(3, 6, 8, copies=4)
    one_r = (5.0, 0.0, 0.1, 0.0, 0.1, 100.0, 0.0)
    one_s = (10.0, 0.1, 0.1, 10.0)
    for i in range(15):
        rocks.append((1000 + i, "c", 4, None, *one_r))
    for i in range(20):
        slugs.append((2000 - i, "c", None, *one_s))
    pairs = brute.candidates(rocks, slugs)
    r, s = frames(spark, rocks, slugs)
    rounds = []
    plain = matching._round

    def counted(*args):
        rounds.append(1)
        return plain(*args)

    monkeypatch.setattr(matching, "_round", counted)
    got = rows(matching.ordered_matching(r, s, budget=1000.0, tail=0, class_tail=class_tail))
    assert got == brute.in_order(pairs)
    assert len(rounds) < 15


def test_hot_cell_is_salted(spark, monkeypatch):
    monkeypatch.setattr(pairing, "_CELL_PAIRS", 20)
    rocks, slugs = brute.scene(4, 30, 40)
    pairs = brute.candidates(rocks, slugs)
    r, s = frames(spark, rocks, slugs)
    assert rows(pairing.candidate_edges(r, s, budget=1e6)) == pairs


def test_order_of_input_does_not_matter(spark):
    rocks, slugs = brute.scene(5, 20, 30)
    r, s = frames(spark, rocks, slugs)
    random.Random(0).shuffle(rocks)
    random.Random(1).shuffle(slugs)
    r2, s2 = frames(spark, rocks, slugs)
    assert rows(matching.ordered_matching(r, s)) == rows(matching.ordered_matching(r2, s2))


def test_empty_sides(spark):
    r, s = frames(spark, [], [])
    assert rows(matching.ordered_matching(r, s)) == set()
    assert rows(pairing.candidate_edges(r, s)) == set()


@pytest.mark.parametrize("tail", [0, 1000])
def test_prototype_pairs(spark, tail):
    edges = [(1, 1), (1, 7), (2, 4), (3, 5), (3, 6), (4, 7), (4, 1)]
    random.Random(7).shuffle(edges)
    df = spark.createDataFrame(edges, "rock long, slug long")
    got = {(r.rock, r.slug) for r in matching.match_pairs(df, ["rock", "slug"], tail).collect()}
    assert got == {(1, 1), (2, 4), (3, 5), (4, 7)}


def test_fold_agrees(spark):
    rocks, slugs = brute.scene(6, 20, 30)
    pairs = brute.candidates(rocks, slugs)
    df = spark.createDataFrame(sorted(pairs), "rock long, slug long, t double")
    assert rows(match_by_fold(df)) == brute.in_order(pairs)
    assert rows(matching.match_pairs(df, ["t", "rock", "slug"], 0)) == brute.in_order(pairs)


def test_one_rock_first_at_two_places_is_hit_once(spark):
    """Both slugs meet the rock at one time, at radii that round apart."""
    rocks = [(1, "r", 4, None, 0.0, 0.0, 0.1, 0.0, 0.1, 42.245000000000005, 0.0)]
    slugs = [(1, "a", None, 29.772499999999994, 0.1, 0.1, 1.0), (2, "b", None, 69.0, 0.1, 0.1, 14.0)]
    slugs += [(10 + i, "c", None, 5.0 + i, 1.0 + i / 10, 1.0, 3.0) for i in range(5)]
    r, s = frames(spark, rocks, slugs)
    got = rows(matching.ordered_matching(r, s, budget=3.0, tail=0, class_tail=0))
    assert {(rock, slug) for rock, slug, _ in got} == {(1, 1)}


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_chains_and_stars(spark, few):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (-3, -7), (-7, -3)]
    edges += [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(35)]
    rng.shuffle(edges)
    known = {}
    for a, b in edges:
        if a != b:
            known.setdefault(a, {a})
            known.setdefault(b, {b})
            whole = known[a] | known[b]
            for x in whole:
                known[x] = whole
    rows = components.components(spark.createDataFrame(edges, "a long, b long"), few).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["label"], set()).add(r["node"])
    assert {r["node"] for r in rows} == set(known) and len(rows) == len(known)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in known.values()}
    assert components.components(spark.createDataFrame([], "a long, b long"), few).count() == 0


@pytest.mark.parametrize(("tail", "class_tail"), [(0, 0), (0, 10**6), (40, 3)])
def test_any_path_gives_the_same(spark, tail, class_tail):
    """Components pair by pair, by classes and by rounds, in one scene of turning and still rocks."""
    rocks, slugs = brute.scene(8, 25, 40, copies=2)
    want = brute.in_order(brute.candidates(rocks, slugs))
    r, s = frames(spark, rocks, slugs)
    assert rows(matching.ordered_matching(r, s, tail=tail, class_tail=class_tail)) == want


def test_cascade_in_slices_is_the_same(spark):
    rocks, slugs = brute.scene(4, 14, 30)
    r, s = frames(spark, rocks, slugs)
    hits, pieces = fragments.cascade(r, s, "continuous")
    cut_hits, cut_pieces = fragments.cascade(r, s, "continuous", budget=150.0)
    assert rows(hits) == rows(cut_hits) and hits.count() > 0
    assert {p.id for p in pieces.collect()} == {p.id for p in cut_pieces.collect()}


def test_closure_of_deep_lineage(spark):
    links = [(i, i - 1 if i % 50 else None) for i in range(200)] + [(900, 7), (901, 900), (902, 999)]
    df = spark.createDataFrame(links, "id long, source long")
    got = fragments.descendants(df, spark.createDataFrame([(3,), (60,), (3,), (999,)], "id long"))
    assert sorted(r["id"] for r in got.collect()) == [*range(4, 50), *range(61, 100), 900, 901, 902]
    circle = spark.createDataFrame([(1, 2), (2, 1)], "id long, source long")
    with pytest.raises(ValueError):
        fragments.descendants(circle, df.select("id").limit(1)).count()


def _tied_scene(seed):
    """Few launches with many copies, several of which meet at the same times; ids of the classes interleave."""
    rng = random.Random(seed)
    rocks, slugs = [], []
    for i in range(60):
        rocks.append((i * 70_001, "c", 4, None, 5.0, 0.0, 0.1, 0.0, 0.1, float(100 * rng.randint(1, 3)), 0.0))
    for i in range(50):
        speed, fired = rng.choice([(10.0, 10.0), (10.0, 10.0), (20.0, 15.0), (20.0, 10.0)])
        theta = rng.choice([0.1, 0.1000001])
        slugs.append((i * 70_001, "c", None, fired, theta, 0.1, speed))
    return rocks, slugs


@pytest.mark.parametrize("seed", range(2))
def test_ties_in_one_pass(spark, monkeypatch, seed):
    """Classes that tie at one time are settled by their ids in one pass; no round and no second pass is needed."""

    def unwanted(*args):
        raise AssertionError("a round or a pass by counts")

    rocks, slugs = _tied_scene(seed)
    want = brute.in_order(brute.candidates(rocks, slugs))
    assert len(want) > 10
    r, s = frames(spark, rocks, slugs)
    monkeypatch.setattr(matching, "_round", unwanted)
    monkeypatch.setattr(matching, "_class_hits", unwanted)
    assert rows(matching.ordered_matching(r, s, budget=100.0, tail=0)) == want


def test_few_labels_need_no_python_task(spark):
    labels = components.components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
    assert len({r.label for r in labels.collect() if r.node in (1, 2, 3)}) == 1


@pytest.mark.parametrize(("members", "n"), [(matching.MEMBERS, 16), (12, 8)])
def test_rounds_go_through_many_hits_of_one_bearing(spark, monkeypatch, members, n):
    """One bearing, whose fastest slugs meet every rock first: a hit a round took as many rounds as rocks."""
    rocks = [(i, "c", 4, None, 0.0, 0.0, 0.1, 0.0, 0.1, float(100 + 7 * i), 0.0) for i in range(n)]
    slugs = [(100 - i, "c", None, float(i % 5), 0.1, 0.1, float(10 + i % 30)) for i in range(n + 9)]
    want = brute.in_order(brute.candidates(rocks, slugs))
    assert len(want) == n
    r, s = frames(spark, rocks, slugs)
    rounds = []
    plain = matching.recounted

    def counted(*args):
        rounds.append(1)
        return plain(*args)

    monkeypatch.setattr(matching, "recounted", counted)
    assert rows(matching.ordered_matching(r, s, tail=0, class_tail=0, members=members)) == want
    # Where a task may hold few members, a round takes the first pair of a bearing until few are left.
    assert 1 < len(rounds) < n


def test_earliest_edges_keep_ties(spark):
    times = [(1, 5.0)] * 3 + [(1, float(t)) for t in range(10, 20)] + [(2, 1.0)] + [(3, 4.0)] * 5
    edges = spark.createDataFrame(times, "comp long, t double")
    found = {c: sorted(r.t for r in matching.earliest(edges, 100).collect() if r.comp == c) for c in (1, 2, 3)}
    assert found == {1: [5.0] * 3 + [10.0, 11.0, 12.0, 13.0], 2: [1.0], 3: [4.0] * 5}
    assert sorted(r.t for r in matching.earliest(edges, 4).collect() if r.comp == 1) == [5.0] * 3 + [10.0]
