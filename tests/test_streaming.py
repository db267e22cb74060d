import random

from bolide.operators import fragments, history, solve
from bolide.sources import tables
from bolide.streaming import counted, maintain, rates, state, versions
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def run(query):
    q = query.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_rates_equal_batch(spark, tmp_path):
    req = tables.requests(spark, FOLDER).withColumn("ts", F.col("ts").cast("timestamp"))
    req.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(req.schema).parquet(str(tmp_path / "in"))
    out = rates.request_rates(stream, 3600, 1, "40 days").writeStream.outputMode("update")
    run(out.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")))
    got = spark.table("rates").groupBy("client", "window_start").agg(F.max("requests").alias("requests"))
    want = rates.request_rates(req, 3600, 1)
    assert want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_pairs_and_latest_equal_batch(spark, tmp_path):
    obs = tables.observations(tables.rocks(spark, FOLDER))
    for part in range(2):
        obs.filter(F.floor(F.col("obs_no") / 2) == part).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in")
    )
    run(
        rates.observation_pairs(stream)
        .writeStream.outputMode("append")
        .format("memory")
        .queryName("pairs")
        .option("checkpointLocation", str(tmp_path / "cp1"))
    )
    keys = ["name", "fired_s"]
    got = solve.fit_pairs(spark.table("pairs"), keys)
    want = solve.two_point_fit(obs)
    assert got.count() == want.count() == 20
    run(
        rates.latest_positions(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("latest")
        .option("checkpointLocation", str(tmp_path / "cp2"))
    )
    want = rates.latest_positions(obs)
    assert spark.table("latest").exceptAll(want).count() == 0


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(spark, folder, parts, name, **options):
    """Pairs of a stream that brings ``parts`` one by one, and the folder of its state."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out = rates.ordered_observation_pairs(stream, **options).writeStream.outputMode("append").format("memory")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        run(out.queryName(name).option("checkpointLocation", str(folder / "cp")))
    finally:
        spark.conf.set(STORE, before)
    return spark.table(name), str(folder / "cp")


def test_pairs_in_order_of_time(spark, tmp_path):
    """Observations that come up to 30 seconds late, over many batches, pair up as in a batch."""
    obs = tables.observations(tables.rocks(spark, FOLDER), shots=7).cache()
    end = obs.limit(1).withColumns({"name": F.lit("end"), "obs_s": F.lit(1e6)})
    arrival = F.floor((F.col("obs_s") + F.pmod(F.xxhash64("rock_id", "obs_no"), F.lit(30))) / 15)
    last = obs.agg(F.max(arrival)).first()[0]
    parts = [obs.filter(arrival == i) for i in range(last + 1)]
    got, _ = _ordered(spark, tmp_path, [p for p in parts if not p.isEmpty()] + [end], "in_order", lateness="50 seconds")
    got = got.select("name", "fired_s", "a.obs_s", F.col("b.obs_s").alias("next_s"), "b.pos_r", "pair_no")
    rows = {}
    for r in sorted(obs.collect(), key=lambda r: (r["obs_s"], r["obs_no"])):
        rows.setdefault((r["name"], r["fired_s"]), []).append(r)
    want = [
        (*key, seen[i]["obs_s"], seen[i + 1]["obs_s"], seen[i + 1]["pos_r"], i // 2)
        for key, seen in rows.items()
        for i in range(0, len(seen) - 1, 2)
    ]
    assert len(want) == 30 and sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_idle_objects_leave_the_state(spark, tmp_path):
    schema = "name string, fired_s double, obs_no long, obs_s double, pos_r double, pos_theta double, pos_phi double"
    seen = lambda name, *times: [(name, 0.0, i, t, t, 0.0, None) for i, t in enumerate(times)]
    first = seen("a", 1.0, 2.0, 3.0) + seen("b", 2.0) + seen(None, 5.0, 4.0)
    later = seen("a", 500.0, 501.0) + seen("b", 38.0)
    parts = [spark.createDataFrame(rows, schema) for rows in (first, later, seen("end", 1e6))]
    got, kept = _ordered(spark, tmp_path, parts, "idle", lateness="1000 seconds", idle_slots=5)
    # The lone third one of "a" was forgotten; "b" came back in time.
    found = {(r["name"], r["a"]["obs_s"], r["b"]["obs_s"], r["pair_no"]) for r in got.collect()}
    assert found == {("a", 1.0, 2.0, 0), ("a", 500.0, 501.0, 0), ("b", 2.0, 38.0, 0), (None, 4.0, 5.0, 0)}
    state = spark.read.format("statestore").option("stateVarName", "last").load(kept)
    assert state.count() == 0


def test_versions_equal_batch(spark, tmp_path):
    feed = tables.changes(spark, FOLDER)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in feed.schema.fields)
    keeper = versions.VersionKeeper(
        spark, str(tmp_path), schema, key="obj_id", at="changed_at", seq="seq"
    )
    for i, (a, b) in enumerate([("1900", "1996"), ("1996", "1999"), ("1999", "2100")]):
        keeper(feed.filter((F.col("changed_at") >= a) & (F.col("changed_at") < b)), i)
    keeper(feed.filter(F.col("changed_at") >= "1999"), 2)  # a replayed batch counts once
    got = keeper.history()
    want = history.history_intervals(feed).select(*got.columns)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_launch_and_look_up(spark, tmp_path):
    rows = [(1, "a"), (2, "b")]
    df = spark.createDataFrame(rows, "id long, name string")
    ids = maintain.launch(df, str(tmp_path / "slugs"))
    active = spark.read.parquet(str(tmp_path / "slugs")).withColumn("type", F.lit("slug"))
    assert {r.id for r in maintain.look_up(active, "slug", ids).collect()} == {1, 2}


def test_versions_late_deleted_and_uncommitted(spark, tmp_path):
    feed = tables.changes(spark, FOLDER).withColumn("gone", F.col("status") == "P")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in feed.schema.fields)
    keeper = versions.VersionKeeper(
        spark, str(tmp_path), schema, key="obj_id", at="changed_at", seq="seq", deleted="gone"
    )
    part = F.pmod(F.xxhash64("seq"), F.lit(3))
    for i in range(3):  # in no order of time
        keeper(feed.filter(part == i), i)
    keeper(feed.filter(part == 1), 3)  # known changes once more
    # Written, but ended before the commit: not seen, and replaced by the next try.
    keeper.tables.write("closed", 4, keeper.tables.read_all("closed").drop("batch").withColumn("seq", F.lit(-1).cast("long")))
    got = keeper.history()
    want = history.history_intervals(feed, deleted=F.col("gone")).select(*got.columns)
    assert 0 < want.count() < feed.count()
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    keeper(feed.limit(0), 4)
    assert keeper.history().exceptAll(want).count() == 0 and keeper.history().count() == want.count()


def _folders(path):
    return {str(p.relative_to(path)) for p in path.glob("*/*/*") if p.is_dir() and "bucket" not in p.name}


def test_delta_tables(spark, tmp_path):
    """A batch writes its own rows, bases replace old deltas, and a replay changes nothing."""
    kept = state.DeltaTables(spark, str(tmp_path), {"t": "id long, v long"}, {"t": "id"}, buckets=4, compact_every=3)
    want = {}

    def rows(df):
        return {r["id"]: r["v"] for r in df.collect()}

    def step(batch, upserts, gone):
        new = spark.createDataFrame(upserts, "id long, v long")
        kept.write("t", batch, new, spark.createDataFrame([(i,) for i in gone], "id long"))

    for batch in range(9):
        upserts = [(i, batch) for i in range(batch, 20, 3)] if batch else [(i, 0) for i in range(500)]
        gone = [batch + 1, 400 + batch, 9999]
        before = kept.latest(before=batch)
        if batch == 4:  # a try that fails before its commit
            step(batch, [(1, -1)], [])
        step(batch, upserts, gone)
        assert rows(kept.read("t", before)) == want
        want.update(upserts)
        for i in set(gone) - {i for i, _ in upserts}:
            want.pop(i, None)
        assert rows(kept.read("t", before, batch)) == want
        kept.commit(batch)
        assert rows(kept.current("t")) == want
        some = spark.createDataFrame([(3,), (9999,), (77,)], "id long")
        assert rows(kept.read("t", batch, keys=some)) == {i: want[i] for i in (3, 77) if i in want}
    files = {b: sum(f.stat().st_size for f in tmp_path.glob(f"t/delta/batch={b}/**/*.parquet")) for b in (7, 8)}
    assert all(0 < n < 12_000 for n in files.values())
    left = _folders(tmp_path)
    assert {x for x in left if x.startswith("t/base")} == {"t/base/batch=5", "t/base/batch=8"}
    assert not list(tmp_path.glob("t/delta/batch=0")) and not list(tmp_path.glob("t/base/batch=2"))


def test_hits_kept_from_a_stream(spark, tmp_path):
    """Hits of a stream of change files equal those of the last state."""
    rocks = [(i, f"r{i}", 3, None, 0.0, 0.0, 0.1 + (i % 2) / 4, 0.0, 0.1, 100.0 + i, 0.0) for i in range(6)]
    slugs = [(i, f"s{i}", None, 1.0 * i, 0.1 + (i % 2) / 4, 0.1, 5.0) for i in range(9)]
    none = (None,) * 5
    changes = [(0, "rock", "upsert", *r, None, None) for r in rocks]
    late = [(1, "slug", "upsert", i, n, None, g, f, *none, v, th, ph) for i, n, g, f, th, ph, v in slugs]
    late.append((2, "rock", "delete", 5, *(None,) * 12))
    for part in (changes, late):
        one = spark.createDataFrame(part, maintain.CHANGES).coalesce(1)
        one.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(maintain.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    views = counted.CountedViews(
        spark,
        str(tmp_path / "views"),
        {
            "families": counted.CountedView("fragments", {"root_name": "root_name"}),
            "minutes": counted.CountedView("hits", {"m": "floor(t / 60)"}, {"slugs": "slug"}),
        },
        {"hits": maintain.HITS, "fragments": maintain.FRAGMENTS},
        buckets=2,
    )
    keeper = maintain.HitKeeper(spark, str(tmp_path / "kept"), rule="continuous", buckets=2, views=views)
    run(maintain.keep_hits(stream, keeper, str(tmp_path / "cp")))
    left = [r for r in rocks if r[0] != 5]
    r = spark.createDataFrame(left, maintain.ROCKS)
    s = spark.createDataFrame(slugs, maintain.SLUGS)
    want = fragments.cascade(r, s, "continuous")[0].select("rock", "slug", "t")
    got = keeper.tables.current("hits")
    assert got.count() == want.count() > 5 and got.exceptAll(want).count() == 0
    assert keeper.tables.current("rocks").count() == 5
    hits, bits = keeper.tables.current("hits"), keeper.tables.current("fragments")
    whole = {
        "families": bits.groupBy("root_name").agg(F.count("*").alias("n")),
        "minutes": hits.groupBy(F.floor(F.col("t") / 60).alias("m")).agg(F.count("*").alias("n"), F.sum("slug")),
    }
    for name, want in whole.items():
        kept = views.view(name)
        assert kept.count() == want.count() > 0 and kept.exceptAll(want).count() == 0


def test_counts_kept_by_signed_changes(spark, tmp_path):
    """Views equal a recount after every batch: groups go and come back, nulls, replays, unfinished tries."""
    rng = random.Random(8)
    schema = "k string, v long"
    view = counted.CountedView("f", {"k": "k", "odd": "v % 2"}, {"total": "v"})
    kept = counted.CountedViews(spark, str(tmp_path), {"w": view}, {"f": schema}, buckets=2, compact_every=2)
    rows = []
    for batch in range(5):
        gone = rng.sample(rows, len(rows) // 2) if batch != 3 else list(rows)
        come = [(rng.choice([None, "a", "b", f"x{batch}"]), rng.choice([None, 1, 2, 3])) for _ in range(12 * (batch != 3))]
        for r in gone:
            rows.remove(r)
        rows += come
        changes = [(*r, "retract") for r in gone] + [(*r, "add") for r in come]
        feed = {"f": spark.createDataFrame(changes, f"{schema}, op string")}
        if batch == 2:  # a try that fails before its commit
            kept._take("w", view, feed["f"].limit(5), kept.tables.latest(before=2), 2)
        kept(feed, batch)
        if batch == 4:
            kept(feed, batch)
        want = {}
        for k, v in rows:
            n, total = want.get((k, v and v % 2), (0, 0))
            want[(k, v and v % 2)] = (n + 1, total + (v or 0))
        assert {(r["k"], r["odd"]): (r["n"], r["total"]) for r in kept.view("w").collect()} == want
