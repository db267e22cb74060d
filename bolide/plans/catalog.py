"""Named queries over one folder of tables: (session, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bolide.functions import numeric as N
from bolide.functions import position as P
from bolide.operators import contention, fragments, history, matching, names
from bolide.operators import pairing, quality, recorded, reports, solve, views, whatif
from bolide.plans import sql_functions
from bolide.plans.settle import checkpoint_root, settle
from bolide.sources import records, tables
from bolide.streaming import counted, maintain

EPOCH = "2024-01-01 00:00:00"
AS_OF = 300.0
ROUNDS = [300.0, 600.0, 1500.0, 100000.0]
# The hypothetical objects of the what-if queries.
NEW_ID = 1000000
NEW_SLUG = {"fired_s": 0.0, "theta": 0.1, "phi": 0.1, "v": 50.0}
NEW_ROCK = {
    "fired_s": 0.0,
    "m_theta": 0.0,
    "b_theta": 0.1,
    "m_phi": 0.0,
    "b_phi": 0.1,
    "r_0": 500.0,
    "v": 0.0,
}

Query = Callable[[SparkSession, str], DataFrame]
_derived: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, folder: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application and read by every view of it."""
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _derived:
        _derived[key] = settle(make(), label)
    return _derived[key]


def rocks(spark: SparkSession, d: str) -> DataFrame:
    return tables.rocks(spark, d)


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return tables.slugs(spark, d)


def _match(r: DataFrame, s: DataFrame) -> DataFrame:
    return views.hit_details(matching.ordered_matching(r, s), r, s)


def hits(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "hits", lambda: _match(rocks(spark, d), slugs(spark, d)))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return pairing.candidate_edges(rocks(spark, d), slugs(spark, d))


def firsts(spark: SparkSession, d: str) -> DataFrame:
    return _once(
        spark, d, "firsts", lambda: matching.first_hit_per_rock(rocks(spark, d), slugs(spark, d))
    )


def objects(spark: SparkSession, d: str, as_of: float = AS_OF) -> DataFrame:
    return views.active_objects(rocks(spark, d), slugs(spark, d), hits(spark, d), as_of)


def _flat(df: DataFrame, struct: str, fields: tuple[str, ...]) -> DataFrame:
    """Struct fields as top-level columns."""
    return df.select(
        *[c for c in df.columns if c != struct],
        *[F.col(f"{struct}.{f}").alias(f"{struct}_{f}") for f in fields],
    )


def flat_objects(df: DataFrame) -> DataFrame:
    df = _flat(df, "rock_params", views.ROCK_PARAMS)
    return _flat(df, "slug_params", views.SLUG_PARAMS)


# --- scans and scalar functions -------------------------------------------


def rounded_positions(spark: SparkSession, d: str) -> DataFrame:
    at = P.round_pos(P.track_pos(P.track(), F.lit(AS_OF + 0.125)), 2)
    return rocks(spark, d).select(
        "id", at.r.alias("pos_r"), at.theta.alias("pos_theta"), at.phi.alias("pos_phi")
    )


def _scaled_rock() -> P.Track:
    return P.Track(F.col("fired_s"), *[c * 1.2345 for c in P.track()[1:]])


def _scaled_slug() -> P.Shot:
    return P.Shot(F.col("fired_s"), *[c * 1.2345 for c in P.shot()[1:]])


def _params(spark: SparkSession, d: str, of_rock, of_slug) -> DataFrame:
    r, s = of_rock(_scaled_rock()), of_slug(_scaled_slug())
    none = F.lit(None).cast("double")
    left = rocks(spark, d).select(
        F.lit("rock").alias("type"),
        "id",
        *[getattr(r, f).alias(f) for f in views.ROCK_PARAMS],
        none.alias("theta"),
        none.alias("phi"),
    )
    right = slugs(spark, d).select(
        F.lit("slug").alias("type"),
        "id",
        *[none.alias(f) for f in views.ROCK_PARAMS if f != "v"],
        s.v.alias("v"),
        s.theta.alias("theta"),
        s.phi.alias("phi"),
    )
    return left.unionByName(right)


def rounded_params(spark: SparkSession, d: str) -> DataFrame:
    return _params(spark, d, lambda r: P.round_track(r, 2), lambda s: P.round_shot(s, 2))


def normalized_params(spark: SparkSession, d: str) -> DataFrame:
    return _params(spark, d, P.normalize_track, P.normalize_shot)


def normalized_positions(spark: SparkSession, d: str) -> DataFrame:
    at = P.normalize(P.track_pos(P.track(), F.lit(-AS_OF)))
    late = P.normalize(P.track_pos(P.track(), F.lit(AS_OF)))
    return rocks(spark, d).select(
        "id",
        at.r.alias("r_before"),
        at.theta.alias("theta_before"),
        at.phi.alias("phi_before"),
        late.theta.alias("theta_after"),
        late.phi.alias("phi_after"),
    )


def to_cartesian(spark: SparkSession, d: str) -> DataFrame:
    c = P.to_cartesian(P.track_pos(P.track(), F.lit(AS_OF)))
    return rocks(spark, d).select(
        "id", *[N.round_away(part, 6).alias(n) for n, part in zip("xyz", c)]
    )


def to_spherical(spark: SparkSession, d: str) -> DataFrame:
    c = P.to_cartesian(P.shot_pos(P.shot(), F.lit(2 * AS_OF)))
    at = P.to_spherical(c)
    return slugs(spark, d).select(
        "id",
        N.round_away(at.r, 6).alias("r"),
        N.round_away(at.theta, 6).alias("theta"),
        N.round_away(at.phi, 6).alias("phi"),
    )


def delayed_positions(spark: SparkSession, d: str) -> DataFrame:
    """Light delay with distances in light seconds' size, so that it shows."""
    far = rocks(spark, d).withColumn("r_0", F.col("r_0") * N.LIGHT_SPEED / 100)
    at = P.track_pos(P.track(), F.lit(AS_OF), delay=True)
    return far.select(
        "id",
        N.round_away(at.r, 6).alias("r"),
        N.round_away(at.theta, 6).alias("theta"),
        N.round_away(at.phi, 6).alias("phi"),
    )


def params_from_impact(spark: SparkSession, d: str) -> DataFrame:
    launch = P.launch_from_impact(F.col("t_impact"))
    return (
        rocks(spark, d)
        .select("id", (F.col("r_0") / 10 + 1).alias("t_impact"))
        .select("id", "t_impact", launch["v"].alias("v"), launch["r_0"].alias("r_0"))
        .withColumn("impact_age", P.impact_age(F.col("r_0"), F.col("v")))
    )


def roman_names(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", N.roman(F.col("p_partkey") % 3999 + 1)).alias("name"),
        N.halved(F.col("p_size")).alias("half_size"),
    )


def timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Launch times as timestamps and back, and ages within the day."""
    fired = N.at_seconds(F.lit(EPOCH), F.col("fired_s") * 1000.5)
    back = N.elapsed_seconds(fired, F.lit(EPOCH))
    return slugs(spark, d).select(
        "id",
        F.date_format(fired, "yyyy-MM-dd HH:mm:ss.SSS").alias("fired"),
        back.alias("back_s"),
        N.seconds_of_day(back).alias("of_day_s"),
        F.date_format(F.date_trunc("day", fired), "yyyy-MM-dd").alias("day"),
    )


def short_names(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), names.short_name(F.col("p_name")).alias("short")
    )


# --- encounters, matching --------------------------------------------------


def collisions_of_slug(spark: SparkSession, d: str) -> DataFrame:
    return views.collisions_of_slug(rocks(spark, d), NEW_ID, NEW_SLUG)


def collisions_of_rock(spark: SparkSession, d: str) -> DataFrame:
    return views.collisions_of_rock(slugs(spark, d), NEW_ID, NEW_ROCK)


def miss_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    both = collisions_of_slug(spark, d).withColumn("of", F.lit("slug")).unionByName(
        collisions_of_rock(spark, d).withColumn("of", F.lit("rock"))
    )
    return both.groupBy("of", F.coalesce("miss", F.lit("hit")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def collisions_named(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the hypothetical slug and rock with the names of both objects."""
    name = ["id", "name"]
    every_rock = rocks(spark, d).select(*name).unionByName(_new_rock(spark).select(*name))
    every_slug = slugs(spark, d).select(*name).unionByName(_new_slug(spark).select(*name))
    pairs = collisions_of_slug(spark, d).unionByName(collisions_of_rock(spark, d))
    return views.named(pairs, every_rock, every_slug).select(
        "rock_name", "slug_name", "miss", "t"
    )


def candidate_hits(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d)


def ordered_matching(spark: SparkSession, d: str) -> DataFrame:
    return matching.ordered_matching(rocks(spark, d), slugs(spark, d))


def ordered_matching_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same with every component matched by classes and rounds."""
    return matching.ordered_matching(rocks(spark, d), slugs(spark, d), tail=0)


def ordered_matching_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same by rounds alone: of each component a task goes through half of the edges that are left at most."""
    return matching.ordered_matching(rocks(spark, d), slugs(spark, d), tail=0, class_tail=0)


def contention_totals(spark: SparkSession, d: str) -> DataFrame:
    return contention.contention_totals(rocks(spark, d), slugs(spark, d))


def sql_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the hypothetical slug, and the slugs of the table at its bearing, by SQL alone."""
    sql_functions.register(spark, rocks(spark, d), slugs(spark, d))
    return spark.sql(
        """
        SELECT c.*, r.name AS rock_name, k.n AS slugs_at_bearing
        FROM collisions_with_slug(1000000, 0D, 0.1D, 0.1D, 50D) AS c
        JOIN rocks AS r ON r.id = c.rock
        LEFT JOIN (SELECT theta_bin(theta) AS theta, phi_bin(phi) AS phi, count(*) AS n FROM slugs GROUP BY 1, 2) AS k
        ON k.theta = theta_bin(c.pos_theta) AND k.phi = phi_bin(c.pos_phi)
        """
    )


def sql_hits(spark: SparkSession, d: str) -> DataFrame:
    """First rock that each of the two hypothetical slugs meets, by SQL alone."""
    sql_functions.register(spark, rocks(spark, d), slugs(spark, d))
    return spark.sql(
        """
        SELECT 50D AS v, min_by(rock, struct(t, rock)) AS rock, min(t) AS t FROM hits_of_slug(1, 0D, 0.1D, 0.1D, 50D)
        UNION ALL
        SELECT 5D AS v, min_by(rock, struct(t, rock)) AS rock, min(t) AS t FROM hits_of_slug(2, 0D, 0.1D, 0.1D, 5D)
        """
    )


def hits_named(spark: SparkSession, d: str) -> DataFrame:
    return views.named(hits(spark, d), rocks(spark, d), slugs(spark, d)).select(
        "rock_name", "slug_name", "t", "pos_r", "pos_theta", "pos_phi"
    )


def _new_slug(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.lit(NEW_ID).cast("long").alias("id"),
        F.lit("new slug").alias("name"),
        F.lit(None).cast("string").alias("target"),
        *[F.lit(v).alias(k) for k, v in NEW_SLUG.items()],
    )


def _new_rock(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.lit(NEW_ID).cast("long").alias("id"),
        F.lit("new rock").alias("name"),
        F.lit(4).cast("long").alias("mass"),
        F.lit(None).cast("string").alias("target"),
        *[F.lit(v).alias(k) for k, v in NEW_ROCK.items()],
    )


def what_if_slug(spark: SparkSession, d: str) -> DataFrame:
    return whatif.what_if_slug(rocks(spark, d), slugs(spark, d), _new_slug(spark))


def what_if_rock(spark: SparkSession, d: str) -> DataFrame:
    return whatif.what_if_rock(rocks(spark, d), slugs(spark, d), _new_rock(spark))


def what_if_pair(spark: SparkSession, d: str) -> DataFrame:
    one = F.lit(1).cast("long")
    pair = spark.range(1).select(one.alias("rock"), one.alias("slug"), F.lit(1.0).alias("t"))
    return whatif.what_if_pair(firsts(spark, d), pair)


def struct_any_not_null(spark: SparkSession, d: str) -> DataFrame:
    df = whatif.active_firsts(rocks(spark, d), firsts(spark, d))
    return whatif.any_not_null(df, "collision").select("rock", "collision.slug", "collision.t")


def hits_changed(spark: SparkSession, d: str, op: str, late: bool) -> DataFrame:
    after_slugs = tables.sped_up(slugs(spark, d), 300.0 if late else None)
    label = "hits-late" if late else "hits-early"
    after = _once(spark, d, label, lambda: _match(rocks(spark, d), after_slugs))
    keys = ["rock", "slug", "t"]
    feed = history.diff(hits(spark, d).select(*keys), after.select(*keys))
    return feed.filter(F.col("op") == op).drop("op")


# --- fragments -------------------------------------------------------------


def first_generation_fragments(spark: SparkSession, d: str) -> DataFrame:
    return fragments.fragments(hits(spark, d), rocks(spark, d), slugs(spark, d)).select(
        "id", "name", "mass", "fired_s", *views.ROCK_PARAMS, "root_name"
    )


def _cascade(spark: SparkSession, d: str, rule: str) -> tuple[DataFrame, DataFrame]:
    made: list[DataFrame] = []

    def run(i: int) -> DataFrame:
        if not made:
            made.extend(fragments.cascade(rocks(spark, d), slugs(spark, d), rule))
        return made[i]

    h = _once(spark, d, f"cascade-hits-{rule}", lambda: run(0))
    f = _once(spark, d, f"cascade-fragments-{rule}", lambda: run(1))
    return h, f


def cascade_hits(rule: str) -> Query:
    return lambda spark, d: _cascade(spark, d, rule)[0].select("rock", "slug", "t")


def cascade_fragments(rule: str) -> Query:
    return lambda spark, d: _cascade(spark, d, rule)[1].select(
        "id", "name", "mass", "fired_s", *views.ROCK_PARAMS
    )


def _world(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rocks with all their fragments, and the hits of the cascade."""
    family = _family(spark, d)
    found = _cascade(spark, d, "continuous")[0].select("rock", "slug", "t")
    return family, views.hit_details(found, family, slugs(spark, d))


def world_objects(spark: SparkSession, d: str) -> DataFrame:
    family, found = _world(spark, d)
    return views.active_objects(family, slugs(spark, d), found, AS_OF)


def active_objects_cascade(spark: SparkSession, d: str) -> DataFrame:
    return world_objects(spark, d).select("type", "id", "name", "pos_r", "octant", "collided_s")


def observe_octant_cascade(spark: SparkSession, d: str) -> DataFrame:
    return views.observe_octant(world_objects(spark, d), 1)


def impacts_cascade(spark: SparkSession, d: str) -> DataFrame:
    family, found = _world(spark, d)
    return views.impacts(family, found, 600.0)


def _family(spark: SparkSession, d: str) -> DataFrame:
    frags = _cascade(spark, d, "continuous")[1]
    return fragments.with_family(rocks(spark, d)).unionByName(frags)


def family_sizes(spark: SparkSession, d: str) -> DataFrame:
    return fragments.family_sizes(_family(spark, d))


def family_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return fragments.family_by_prefix(_family(spark, d), "Supplier#00000000").select("id", "name")


def cascading_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of all rocks and fragments when every third root and all that came from it go."""
    family = settle(_family(spark, d), "family")
    roots = family.filter("generation = 0 and id % 3 = 0").select("id")
    return fragments.cascading_delete(family, roots).select("id", "name", "generation")


def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of two customers where each comes from the one with half its number."""
    key = F.col("c_custkey")
    links = tables.table(spark, d, "customer").select(
        key.alias("id"), F.when(key > 1, F.floor(key / 2)).cast("long").alias("source")
    )
    return fragments.descendants(links, spark.createDataFrame([(5,), (14,)], "id long"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return fragments.static_fragments(firsts(spark, d), rocks(spark, d), slugs(spark, d))


def static_fragments(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).drop("rock", "piece")


def fragment_collisions(spark: SparkSession, d: str) -> DataFrame:
    """First slug met by each static piece."""
    pieces = settle(fragments.as_rocks(_pieces(spark, d)), "pieces")
    met = matching.first_hit_per_rock(pieces, slugs(spark, d))
    return met.select(F.col("rock").alias("fragment"), "slug", N.round_away(F.col("t"), 6).alias("t"))


def fragment_collisions_aimed(spark: SparkSession, d: str) -> DataFrame:
    """First slug met by each static piece, if a slug is fired at every piece as it breaks off."""
    pieces = settle(fragments.as_rocks(_pieces(spark, d)), "pieces")
    aimed = pieces.select(
        "id",
        "name",
        F.lit(None).cast("string").alias("target"),
        "fired_s",
        F.col("b_theta").alias("theta"),
        F.col("b_phi").alias("phi"),
        (20 + F.col("id") % 7).cast("double").alias("v"),
    )
    met = matching.first_hit_per_rock(pieces, settle(aimed, "aimed"))
    return met.select(F.col("rock").alias("fragment"), "slug", N.round_away(F.col("t"), 6).alias("t"))


# --- views and reports -----------------------------------------------------


def active_objects(spark: SparkSession, d: str) -> DataFrame:
    return objects(spark, d).select("type", "id", "pos_r", "octant", "collided_s")


def observe_octant(spark: SparkSession, d: str) -> DataFrame:
    return views.observe_octant(objects(spark, d), 1)


def lookup_object(spark: SparkSession, d: str) -> DataFrame:
    return views.lookup_object(objects(spark, d), "slug", 77).select("type", "id", "name", "pos_r")


def observations_json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields read back from the JSON form of the observations."""
    text = views.observation_json(views.sky_scan(objects(spark, d)), EPOCH)
    body = F.from_json(
        "body",
        "id long, type string, name string, mass long, fired string,"
        " pos struct<r:double,theta:double>, obs_time string, octant int, age long",
    )
    return text.select(body.alias("b")).select(
        "b.id",
        "b.type",
        "b.name",
        "b.mass",
        "b.fired",
        F.col("b.pos.r").alias("pos_r"),
        "b.obs_time",
        "b.octant",
        "b.age",
    )


def impacts(spark: SparkSession, d: str) -> DataFrame:
    return views.impacts(rocks(spark, d), hits(spark, d), 600.0)


def impact_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.impact_report(impacts(spark, d), EPOCH)


def hits_of_live_rocks(spark: SparkSession, d: str) -> DataFrame:
    return views.hits_of_live_rocks(hits(spark, d), objects(spark, d)).select("rock", "slug", "t")


def eta_signed(spark: SparkSession, d: str) -> DataFrame:
    return _finite(reports.eta(objects(spark, d)), "eta")


def time_to_impact(spark: SparkSession, d: str) -> DataFrame:
    return _finite(reports.impact_countdown(objects(spark, d)), "time_to_impact")


def _finite(df: DataFrame, name: str) -> DataFrame:
    """Infinity as a flag column, so that values compare as numbers."""
    never = F.col(name) == F.lit(float("inf"))
    return df.withColumn("never", never).withColumn(name, F.when(~never, F.col(name)))


def top_oldest_rocks(spark: SparkSession, d: str) -> DataFrame:
    return _finite(reports.oldest_rocks(objects(spark, d)), "time_to_impact")


def top_newest_slugs(spark: SparkSession, d: str) -> DataFrame:
    return reports.newest_slugs(objects(spark, d))


def all_clear_rounds(spark: SparkSession, d: str) -> DataFrame:
    return reports.all_clear(rocks(spark, d), hits(spark, d), ROUNDS)


# --- observations ----------------------------------------------------------


def _observed(spark: SparkSession, d: str) -> DataFrame:
    return tables.observations(rocks(spark, d))


def last_position(spark: SparkSession, d: str) -> DataFrame:
    return reports.last_position(_observed(spark, d))


def _fits(spark: SparkSession, d: str) -> DataFrame:
    return solve.two_point_fit(_observed(spark, d))


def two_point_fit(spark: SparkSession, d: str) -> DataFrame:
    df = _fits(spark, d)
    for c in ("v", "r_0", "m_theta", "b_theta", "m_phi", "b_phi"):
        df = df.withColumn(c, N.round_away(F.col(c), 6))
    return df


def firing_solutions(spark: SparkSession, d: str) -> DataFrame:
    df = solve.firing_solutions(_fits(spark, d), slug_v=25.0)
    for c in ("t_collide", "r_collide", "theta", "phi"):
        df = df.withColumn(c, N.round_away(F.col(c), 6))
    return df


def sample_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return solve.sample_trajectory(rocks(spark, d), 1000, 50)


# --- history ---------------------------------------------------------------


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return tables.changes(spark, d)


def history_intervals(spark: SparkSession, d: str) -> DataFrame:
    return history.history_intervals(_feed(spark, d))


def history_as_of(spark: SparkSession, d: str) -> DataFrame:
    when = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    return history.history_as_of(_feed(spark, d), when).select("obj_id", "seq", "status", "amount")


def history_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """State of each order's customer when each of its lines shipped."""
    lines = tables.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate"
    )
    owners = tables.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("obj_id")
    )
    probes = lines.join(owners, "l_orderkey")
    return history.history_as_of_join(
        probes, _feed(spark, d), "l_shipdate", ["seq", "status", "amount"]
    ).select("l_orderkey", "l_linenumber", "obj_id", "seq", "status", "amount")


def history_with_deletes(spark: SparkSession, d: str) -> DataFrame:
    """Periods of a feed in which the changes to status P are deletions."""
    return history.history_intervals(_feed(spark, d), deleted=F.col("status") == "P").select(
        "obj_id", "seq", "status", "amount", "valid_from", "valid_to"
    )


def field_changes(spark: SparkSession, d: str) -> DataFrame:
    return history.field_changes(_feed(spark, d), "status").select(
        "obj_id", "seq", "old_status", "new_status"
    )


def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    before = slugs(spark, d)
    return history.changed_rows(before, tables.sped_up(before)).select("id", "v")


def _recorded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Periods of rocks, slugs and hits; no hit is known when history begins."""
    start = F.lit("1992-01-01 00:00:00").cast("timestamp_ntz")
    r = rocks(spark, d).select(F.col("id").alias("rock"), F.col("mass"))
    s = slugs(spark, d).select(F.col("id").alias("slug"), "v")
    met = _once(spark, d, "hit-changes", lambda: tables.hit_changes(spark, d))
    none = met.drop("changed_at", "seq", "gone").limit(0)

    def periods(label: str, table: DataFrame, feed: DataFrame, key: str) -> DataFrame:
        made = lambda: recorded.recorded_periods(table, feed, key, start)
        return _once(spark, d, f"{label}-periods", made)

    return (
        periods("rock", r, tables.rock_changes(spark, d), "rock"),
        periods("slug", s, tables.slug_changes(spark, d), "slug"),
        periods("hit", none, met, "slug"),
    )


def recorded_world(spark: SparkSession, d: str) -> DataFrame:
    """The hits known on one day, with rocks and slugs as they were known then."""
    return recorded.world_at(*_recorded(spark, d), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))


def recorded_hits(spark: SparkSession, d: str) -> DataFrame:
    """What each recorded hit's rock and slug went through while it stood."""
    end = F.lit("2005-01-01 00:00:00").cast("timestamp_ntz")
    return recorded.hit_records(*_recorded(spark, d), end)


def kept_speed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Slugs per target and speed, kept by signed changes: all come, some speed up, some go."""
    before = slugs(spark, d)
    after = tables.sped_up(before).filter(F.col("id") % 7 != 0)
    view = counted.CountedView("slugs", {"target": "target", "speed": "cast(v as long)"}, {"ids": "id"})
    path = f"{checkpoint_root(spark)}/bolide/counts-{uuid.uuid4().hex}"
    kept = counted.CountedViews(spark, path, {"speeds": view}, {"slugs": maintain.SLUGS}, compact_every=2)
    columns = before.columns
    feeds = [before.withColumn("op", F.lit("add")), history.diff(before, after.select(*columns))]
    for batch, feed in enumerate(feeds):
        kept({"slugs": feed}, batch)
    return kept.view("speeds")


# --- quality ---------------------------------------------------------------


def validate_requests(spark: SparkSession, d: str) -> DataFrame:
    checked = quality.validated(
        tables.requests(spark, d), ["theta_txt"], F.col("fire_offset_s")
    )
    return checked.select(
        "event_id", "client", "name", F.col("theta_txt_rad").alias("theta"), "reject_reason"
    )


def _timed(spark: SparkSession, d: str) -> DataFrame:
    clock = quality.launch_time(F.col("fired"), F.col("ts"), "UTC")
    timed = tables.timed_requests(spark, d).withColumn("launch", clock)
    offset = (F.unix_micros("launch") - F.unix_micros("ts")) / 1e6
    return quality.validated(timed, ["theta_txt"], offset, fired_text=F.col("fired"))


def validate_launch_times(spark: SparkSession, d: str) -> DataFrame:
    return _timed(spark, d).select("event_id", "name", "fired", "reject_reason")


def accepted_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of the accepted requests; without a clock time they start at once."""
    start = F.coalesce("launch", "ts")
    fired_s = (F.unix_micros(start) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / 1e6
    return quality.launched(
        _timed(spark, d), "event_id", fired_s, F.col("theta_txt_rad"), F.lit(0.1), F.lit(NEW_SLUG["v"])
    )


def rate_limit_violations(spark: SparkSession, d: str) -> DataFrame:
    found = quality.rate_limit_violations(tables.requests(spark, d), 3600, 1)
    return found.withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    )


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Of rocks with gaps: no name for every fourth id, no speed for those of mass 3."""
    gaps = rocks(spark, d).withColumns(
        {
            "name": F.when(F.col("id") % 4 != 0, F.col("name")),
            "v": F.when(F.col("mass") != 3, F.col("v")),
        }
    )
    return quality.constraint_violations(gaps, ["name", "mass", *views.ROCK_PARAMS])


def matching_invariants(spark: SparkSession, d: str) -> DataFrame:
    return contention.matching_invariants(hits(spark, d))


def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose rock is gone after the rocks on turning courses are removed."""
    kept = rocks(spark, d).filter("m_phi = 0")
    return quality.dangling_references(hits(spark, d), "rock", kept).select("rock", "slug", "t")


def dangling_references_all(spark: SparkSession, d: str) -> DataFrame:
    """Hits and fragments whose rock, slug or hit is gone.

    Removed are rocks on turning courses, every tenth slug, and hits from second 300 on.
    """
    found, pieces = hits(spark, d), first_generation_fragments(spark, d)
    source = rocks(spark, d).select(F.col("id").alias("source_rock"), F.col("name").alias("root_name"))
    pieces = pieces.join(source, "root_name").withColumn("source_hit", F.col("source_rock"))
    kept_rocks = rocks(spark, d).filter("m_phi = 0")
    kept_slugs = slugs(spark, d).filter("id % 10 <> 0")
    kept_hits = found.filter("t < 300")

    def gone(child: DataFrame, column: str, parent: DataFrame, key: str, own: str) -> DataFrame:
        return quality.dangling_references(child, column, parent, key).select(
            F.lit(column).alias("column"), F.col(own).alias("id")
        )

    return (
        gone(found, "rock", kept_rocks, "id", "rock")
        .unionByName(gone(found, "slug", kept_slugs, "id", "slug"))
        .unionByName(gone(pieces, "source_rock", kept_rocks, "id", "id"))
        .unionByName(gone(pieces, "source_hit", kept_hits, "rock", "id"))
    )


def queries() -> dict[str, Query]:
    return {
        "scan_rocks": rocks,
        "scan_slugs": slugs,
        "rounded_positions": rounded_positions,
        "rounded_params": rounded_params,
        "normalized_positions": normalized_positions,
        "normalized_params": normalized_params,
        "to_cartesian": to_cartesian,
        "to_spherical": to_spherical,
        "delayed_positions": delayed_positions,
        "params_from_impact": params_from_impact,
        "roman_names": roman_names,
        "launch_timestamps": timestamps,
        "short_names": short_names,
        "collisions_of_slug": collisions_of_slug,
        "collisions_of_rock": collisions_of_rock,
        "miss_reason_counts": miss_reason_counts,
        "collisions_named": collisions_named,
        "candidate_hits": candidate_hits,
        "ordered_matching": ordered_matching,
        "ordered_matching_classes": ordered_matching_classes,
        "ordered_matching_rounds": ordered_matching_rounds,
        "contention_totals": contention_totals,
        "sql_collisions": sql_collisions,
        "sql_hits": sql_hits,
        "cascading_delete": cascading_delete,
        "lineage_closure": lineage_closure,
        "hits_named": hits_named,
        "first_hit_per_rock": firsts,
        "first_rock_per_slug": lambda s, d: contention.first_rock_per_slug(firsts(s, d)),
        "first_rock_per_slug_distinct_on": lambda s, d: contention.earliest_rock_per_slug(
            firsts(s, d)
        ),
        "contention_counts": lambda s, d: contention.contention_counts_of(rocks(s, d), slugs(s, d)),
        "contention_ranks": lambda s, d: contention.contention_ranks_of(rocks(s, d), slugs(s, d)),
        "mutual_first": lambda s, d: contention.mutual_first_of(rocks(s, d), slugs(s, d)),
        "struct_any_not_null": struct_any_not_null,
        "what_if_slug": what_if_slug,
        "what_if_rock": what_if_rock,
        "what_if_pair": what_if_pair,
        "hits_retracted": lambda s, d: hits_changed(s, d, "retract", late=False),
        "hits_added": lambda s, d: hits_changed(s, d, "add", late=False),
        "hits_retracted_late": lambda s, d: hits_changed(s, d, "retract", late=True),
        "hits_added_late": lambda s, d: hits_changed(s, d, "add", late=True),
        "first_generation_fragments": first_generation_fragments,
        "cascade_hits": cascade_hits("reference"),
        "cascade_fragments": cascade_fragments("reference"),
        "cascade_hits_continuous": cascade_hits("continuous"),
        "cascade_fragments_continuous": cascade_fragments("continuous"),
        "family_sizes": family_sizes,
        "family_by_prefix": family_by_prefix,
        "static_fragments": static_fragments,
        "fragment_collisions": fragment_collisions,
        "fragment_collisions_aimed": fragment_collisions_aimed,
        "rocks_at": lambda s, d: views.rocks_at(rocks(s, d), hits(s, d), AS_OF),
        "slugs_at": lambda s, d: views.slugs_at(slugs(s, d), hits(s, d), AS_OF),
        "all_objects": lambda s, d: flat_objects(
            views.all_objects(rocks(s, d), slugs(s, d), hits(s, d), AS_OF)
        ),
        "active_objects": active_objects,
        "observe_octant": observe_octant,
        "sky_scan": lambda s, d: views.sky_scan(objects(s, d)),
        "octant_histogram": lambda s, d: reports.octant_histogram(objects(s, d)),
        "lookup_object": lookup_object,
        "observations_json_fields": observations_json_fields,
        "impacts": impacts,
        "impact_report": impact_report,
        "hits_of_live_rocks": hits_of_live_rocks,
        "eta_signed": eta_signed,
        "time_to_impact": time_to_impact,
        "top_oldest_rocks": top_oldest_rocks,
        "top_newest_slugs": top_newest_slugs,
        "all_clear_rounds": all_clear_rounds,
        "last_position": last_position,
        "two_point_fit": two_point_fit,
        "firing_solutions": firing_solutions,
        "sample_trajectory": sample_trajectory,
        "history_intervals": history_intervals,
        "history_as_of": history_as_of,
        "history_as_of_join": history_as_of_join,
        "field_changes": field_changes,
        "changed_rows": changed_rows,
        "validate_requests": validate_requests,
        "rate_limit_violations": rate_limit_violations,
        "constraint_violations": constraint_violations,
        "matching_invariants": matching_invariants,
        "dangling_references": dangling_references,
        "dangling_references_all": dangling_references_all,
        "active_objects_cascade": active_objects_cascade,
        "observe_octant_cascade": observe_octant_cascade,
        "impacts_cascade": impacts_cascade,
        "history_with_deletes": history_with_deletes,
        "recorded_world": recorded_world,
        "kept_speed_counts": kept_speed_counts,
        "recorded_hits": recorded_hits,
        "validate_launch_times": validate_launch_times,
        "accepted_slugs": accepted_slugs,
    }
