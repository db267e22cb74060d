"""Which rocks meet which slugs, without pairing every rock with every slug.

A hit needs both at one r, with equal bearing bins, at one time. Three things
follow, and the join uses all of them as equality keys:

* Copies: objects launched alike meet alike. Objects are folded into launch
  classes first, so a class is compared once however many copies it has.
* Bearing: a slug keeps its bins, and so does a rock with zero slopes. A turning
  rock lists the bins it sweeps during a time slice, or, when it sweeps too
  many, leaves that angle out of its key.
* Radius: within a time slice an object covers an interval of r. Intervals are
  binned on a ladder of grids (cell width = power of two at least the interval),
  so that each object takes a few cells whatever its speed.

The exact verdict is then the residual condition of the equi-join. A slice whose
candidate pairs (bounded beforehand from counts per cell) exceed a budget
that is linear in the input is cut in two along time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.functions.encounter import is_hit, meeting_time
from bolide.functions.numeric import hundredths
from bolide.functions.position import (
    SHOT_FIELDS,
    TRACK_FIELDS,
    Track,
    phi_bin,
    shot,
    shot_pos,
    theta_bin,
    track,
)
from bolide.plans.settle import settle
from bolide.plans.skew import id_chunk, ranked, small

# No bin has this number, so it marks an angle left out of the key.
_ANY = 9999
# A turning rock lists its bins up to this many half-bins per slice.
_SWEEP = 128
# Candidate pairs of one cell that one task may test; cells above are salted.
_CELL_PAIRS = 4_000_000
# Object pairs that one task forms from class edges, and members of a class in one list; both are spread by count.
TASK_PAIRS = 1 << 23
LIST = 1 << 10
# Rungs of the radius ladder below the widest interval.
_RUNGS = 24


class Slice(NamedTuple):
    """Times from ``start`` (inclusive) to ``end`` (exclusive, None for ever)."""

    start: float
    end: float | None


class Scope(NamedTuple):
    """A few scalars over both inputs that bound where encounters can be."""

    begin: float
    last_fired: float
    min_slug_v: float
    max_slug_v: float
    turns_theta: bool
    turns_phi: bool
    rocks: int
    slugs: int

    @property
    def origin(self) -> float:
        return self.begin - 1.0


class Bound(NamedTuple):
    pairs: float
    largest_cell: float


# --- launch classes -------------------------------------------------------


def launch_key(fields: tuple[str, ...]) -> Column:
    """Digest of the launch columns; adding 0.0 folds the two zeros."""
    return F.md5(F.concat_ws("|", *[(F.col(f) + F.lit(0.0)).cast("string") for f in fields]))


def with_launch(df: DataFrame, fields: tuple[str, ...], fold: bool = True) -> DataFrame:
    """Objects with the key of their launch class; unfolded, each is its own class."""
    key = launch_key(fields) if fold else F.col("id").cast("string")
    return df.select("id", key.alias("launch"), *fields)


def launch_classes(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per distinct launch: number of copies, lowest id, launch columns."""
    return df.groupBy("launch").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("id").alias("lo"),
        *[F.first(f).alias(f) for f in fields],
    )


def scope_of(rocks: DataFrame, slugs: DataFrame) -> Scope | None:
    """Scalars over both sides; None when either is empty."""
    side_r = rocks.select(
        F.lit(1).alias("is_rock"),
        "fired_s",
        F.lit(None).cast("double").alias("slug_v"),
        (F.col("m_theta") != 0).cast("int").alias("turns_theta"),
        (F.col("m_phi") != 0).cast("int").alias("turns_phi"),
    )
    nothing = F.lit(None).cast("int")
    side_s = slugs.select(
        F.lit(0).alias("is_rock"),
        "fired_s",
        F.col("v").alias("slug_v"),
        nothing.alias("turns_theta"),
        nothing.alias("turns_phi"),
    )
    rock = F.col("is_rock") == 1
    row = (
        side_r.unionByName(side_s)
        .agg(
            F.count_if(rock).alias("n_r"),
            F.count_if(~rock).alias("n_s"),
            F.min(F.when(rock, F.col("fired_s"))).alias("first_r"),
            F.min(F.when(~rock, F.col("fired_s"))).alias("first_s"),
            F.max("fired_s").alias("last"),
            F.min("slug_v").alias("v_min"),
            F.max(F.abs("slug_v")).alias("v_max"),
            F.max("turns_theta").alias("turns_theta"),
            F.max("turns_phi").alias("turns_phi"),
        )
        .first()
    )
    if not row.n_r or not row.n_s:
        return None
    return Scope(
        begin=max(row.first_r, row.first_s),
        last_fired=row.last,
        min_slug_v=row.v_min,
        max_slug_v=row.v_max,
        turns_theta=bool(row.turns_theta),
        turns_phi=bool(row.turns_phi),
        rocks=row.n_r,
        slugs=row.n_s,
    )


# --- keys -----------------------------------------------------------------


def _swept(lo: Column, hi: Column, to_bin) -> Column:
    """Every bin an angle can take between two raw values, and its neighbours.

    Half-bin samples meet each whole bin; neighbours cover the partial
    bins next to the wrap-around.
    """
    steps = F.sequence(
        (F.floor(lo * 200) - 1).cast("long"), (F.ceil(hi * 200) + 1).cast("long")
    )
    near = F.transform(steps, lambda k: to_bin(k / F.lit(200.0)).cast("int"))
    return F.array_distinct(F.flatten(F.transform(near, lambda b: F.array(b - 1, b, b + 1))))


def _angle_bins(slope: Column, a: Column, b: Column, room: Column, to_bin) -> Column:
    lo, hi = F.least(a, b), F.greatest(a, b)
    return (
        F.when(slope == 0, F.array(to_bin(a).cast("int")))
        .when(F.abs(b - a) * 200 <= room, _swept(lo, hi, to_bin))
        .otherwise(F.array(F.lit(_ANY)))
    )


def _rock_window(rock: Track, sl: Slice, scope: Scope) -> tuple[Column, Column]:
    """Part of the slice a rock can be met in; an open end is null.

    With no slug moving inward, none has a negative r, so an inbound
    rock cannot be met after it has passed the origin.
    """
    begin = F.greatest(F.lit(sl.start), rock.fired_s)
    ends = [F.lit(sl.end).cast("double")]
    if scope.min_slug_v >= 0:
        passed = rock.fired_s + rock.r_0 / -F.when(rock.v < 0, rock.v)
        ends.append(passed + F.lit(1e-6) + F.abs(passed) * F.lit(1e-9))
    return begin, F.least(*ends) if len(ends) > 1 else ends[0]


def _bearing_rocks(classes: DataFrame, sl: Slice, scope: Scope) -> DataFrame:
    rock = track()
    begin, end = _rock_window(rock, sl, scope)
    live = classes.withColumn("_a", begin).withColumn("_b", end)
    live = live.filter(F.col("_b").isNull() | (F.col("_b") >= F.col("_a")))
    if sl.end is not None:
        live = live.filter(F.col("fired_s") < sl.end)
    age_a, age_b = F.col("_a") - rock.fired_s, F.col("_b") - rock.fired_s
    theta = _angle_bins(
        rock.m_theta,
        rock.m_theta * age_a + rock.b_theta,
        rock.m_theta * age_b + rock.b_theta,
        F.lit(_SWEEP),
        theta_bin,
    )
    # When both angles turn, the second list stays short: the lists multiply.
    phi = _angle_bins(
        rock.m_phi,
        rock.m_phi * age_a + rock.b_phi,
        rock.m_phi * age_b + rock.b_phi,
        F.when(rock.m_theta == 0, _SWEEP).otherwise(8),
        phi_bin,
    )
    return live.withColumn("k_theta", F.explode(theta)).withColumn("k_phi", F.explode(phi))


def _bearing_slugs(classes: DataFrame, sl: Slice, scope: Scope) -> DataFrame:
    slug = shot()
    live = classes if sl.end is None else classes.filter(F.col("fired_s") < sl.end)
    any_bin = F.lit(_ANY)
    theta, phi = theta_bin(slug.theta).cast("int"), phi_bin(slug.phi).cast("int")
    thetas = F.array(theta, any_bin) if scope.turns_theta else F.array(theta)
    phis = F.array(phi, any_bin) if scope.turns_phi else F.array(phi)
    return (
        live.withColumn("_a", F.greatest(F.lit(sl.start), slug.fired_s))
        .withColumn("_b", F.lit(sl.end).cast("double"))
        .withColumn("k_theta", F.explode(thetas))
        .withColumn("k_phi", F.explode(phis))
    )


def _along(r: Column, t: Column, sl: Slice, scope: Scope) -> Column:
    """Radial coordinate in which tracks stay linear over the slice.

    Over an unbounded slice that is r / t, against 1 / t: it tends to the speed.
    """
    return r if sl.end is not None else r / (t - F.lit(scope.origin))


def _interval(df: DataFrame, radius, v: Column, sl: Slice, scope: Scope) -> DataFrame:
    a, b = F.col("_a"), F.col("_b")
    at_a = _along(radius(a), a, sl, scope)
    at_b = F.when(b.isNotNull(), _along(radius(b), b, sl, scope)).otherwise(v)
    # Rounding in t and r must not move a meeting out of the cells.
    slack = (
        (F.abs(v) + F.lit(scope.max_slug_v)) * F.lit(2e-6)
        + (F.abs(at_a) + F.abs(at_b)) * F.lit(1e-9)
        + F.lit(1e-9)
    )
    df = df.withColumn("_lo", F.least(at_a, at_b) - slack)
    df = df.withColumn("_hi", F.greatest(at_a, at_b) + slack)
    return df.withColumn("_rung", F.ceil(F.log2(F.col("_hi") - F.col("_lo"))).cast("int"))


def _rungs(rocks: DataFrame, slugs: DataFrame) -> tuple[list[int], list[int]]:
    """Distinct rungs of both sides: exponents of doubles, so few by construction."""
    sides = rocks.select("_rung", F.lit(True).alias("rock")).unionByName(
        slugs.select("_rung", F.lit(False).alias("rock"))
    )
    found = sides.distinct().collect()
    return [x._rung for x in found if x.rock], [x._rung for x in found if not x.rock]


def _cells(df: DataFrame, own_side: int, others: list[int], base: int) -> DataFrame:
    """Grid cells of each object.

    A pair meets on the coarser of its two rungs: side 0 is the rock's rung
    (not finer than the slug's), side 1 the slug's where that is coarser.
    """
    own = F.greatest(F.col("_rung"), F.lit(base))
    rungs = sorted({max(r, base) for r in others})
    listed = F.array(*[F.lit(r) for r in rungs])
    strict = own_side == 0
    coarser = F.filter(listed, lambda r: (r > own) if strict else (r >= own))

    def on(side: int, rung: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), rung.alias("rung"))

    spots = F.concat(
        F.array(on(own_side, own)), F.transform(coarser, lambda r: on(1 - own_side, r))
    )
    width = F.pow(F.lit(2.0), F.col("k_rung"))
    return (
        df.withColumn("_spot", F.explode(spots))
        .withColumn("k_side", F.col("_spot.side"))
        .withColumn("k_rung", F.col("_spot.rung"))
        .withColumn(
            "k_cell",
            F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))),
        )
    )


class Keyed(NamedTuple):
    """Both sides with their join keys for one slice."""

    rocks: DataFrame
    slugs: DataFrame
    keys: list[str]
    gridded: bool


def keyed(rocks: DataFrame, slugs: DataFrame, sl: Slice, scope: Scope, grid: bool) -> Keyed:
    r = _bearing_rocks(rocks, sl, scope)
    s = _bearing_slugs(slugs, sl, scope)
    keys = ["k_theta", "k_phi"]
    if grid:
        rock, slug = track(), shot()
        r = _interval(r, lambda t: rock.r_0 + rock.v * (t - rock.fired_s), rock.v, sl, scope)
        s = _interval(s, lambda t: slug.v * (t - slug.fired_s), slug.v, sl, scope)
        r_rungs, s_rungs = _rungs(r, s)
        if r_rungs and s_rungs:
            base = max(r_rungs + s_rungs) - _RUNGS
            r, s = _cells(r, 0, s_rungs, base), _cells(s, 1, r_rungs, base)
            keys = keys + ["k_side", "k_rung", "k_cell"]
        else:
            grid = False
    return Keyed(
        r.select(*keys, "launch", "n", "lo", *TRACK_FIELDS),
        s.select(*keys, "launch", "n", "lo", *SHOT_FIELDS),
        keys,
        grid,
    )


def keyed_by_course(rocks: DataFrame, slugs: DataFrame, scope: Scope) -> Keyed:
    """Keys for all time at once: the bins of a still angle, none for a turning one."""

    def course(slope: str, bin_: Column) -> Column:
        return F.when(F.col(slope) == 0, bin_.cast("int")).otherwise(F.lit(_ANY))

    rock, slug = track(), shot()
    r = rocks.select(
        course("m_theta", theta_bin(rock.b_theta)).alias("k_theta"),
        course("m_phi", phi_bin(rock.b_phi)).alias("k_phi"),
        F.col("id").cast("string").alias("launch"),
        F.lit(1).cast("long").alias("n"),
        F.col("id").alias("lo"),
        *TRACK_FIELDS,
    )
    theta, phi = theta_bin(slug.theta).cast("int"), phi_bin(slug.phi).cast("int")
    keys = [
        F.struct(t.alias("theta"), p.alias("phi"))
        for t in ([theta, F.lit(_ANY)] if scope.turns_theta else [theta])
        for p in ([phi, F.lit(_ANY)] if scope.turns_phi else [phi])
    ]
    s = slugs.select("id", F.explode(F.array(*keys)).alias("k"), *SHOT_FIELDS).select(
        F.col("k.theta").alias("k_theta"),
        F.col("k.phi").alias("k_phi"),
        F.col("id").cast("string").alias("launch"),
        F.lit(1).cast("long").alias("n"),
        F.col("id").alias("lo"),
        *SHOT_FIELDS,
    )
    return Keyed(r, s, ["k_theta", "k_phi"], False)


def _cell_pairs(k: Keyed) -> DataFrame:
    """Candidate pairs per cell from counts alone (partial aggregates, no pairs)."""
    r = k.rocks.groupBy(*k.keys).agg(F.count(F.lit(1)).alias("c_r"))
    s = k.slugs.groupBy(*k.keys).agg(F.count(F.lit(1)).alias("c_s"))
    return r.join(s, k.keys).withColumn("pairs", F.col("c_r").cast("double") * F.col("c_s"))


def pair_bound(k: Keyed) -> Bound:
    row = _cell_pairs(k).agg(F.sum("pairs"), F.max("pairs")).first()
    return Bound(row[0] or 0.0, row[1] or 0.0)


def class_edges(k: Keyed, bound: Bound, sl: Slice, scope: Scope) -> DataFrame:
    """Class pairs that hit within the slice, each once, with where they meet."""
    r, s, keys = k.rocks, k.slugs, k.keys
    if bound.largest_cell > _CELL_PAIRS:
        parts = F.ceil(F.col("pairs") / F.lit(float(_CELL_PAIRS))).cast("int")
        hot = small(
            _cell_pairs(k).filter(F.col("pairs") > _CELL_PAIRS).select(*keys, parts.alias("_p"))
        )
        pieces = F.coalesce(F.col("_p"), F.lit(1))
        # Split the slugs of a hot cell; repeat its rocks once per piece.
        s = s.join(hot, keys, "left").withColumn(
            "k_salt", F.pmod(F.xxhash64("launch"), pieces).cast("int")
        ).drop("_p")
        r = r.join(hot, keys, "left").withColumn(
            "k_salt", F.explode(F.sequence(F.lit(0), pieces - 1))
        ).drop("_p")
        keys = keys + ["k_salt"]
    r = r.select(*keys, *[F.col(c).alias(f"r_{c}") for c in ("launch", "n", "lo", *TRACK_FIELDS)])
    s = s.select(*keys, *[F.col(c).alias(f"s_{c}") for c in ("launch", "n", "lo", *SHOT_FIELDS)])
    rock, slug = track("r_"), shot("s_")
    met = r.join(s, keys).withColumn("t", meeting_time(rock, slug))
    t = F.col("t")
    met = met.filter((t >= sl.start) & is_hit(t, rock, slug))
    if sl.end is not None:
        met = met.filter(t < sl.end)
    at = shot_pos(slug, t)
    if k.gridded:
        # Several cells may hold both; keep the one where they meet.
        width = F.pow(F.lit(2.0), F.col("k_rung"))
        met = met.filter(F.col("k_cell") == F.floor(_along(at.r, t, sl, scope) / width))
    return met.select(
        "r_launch",
        "s_launch",
        "t",
        "r_n",
        "s_n",
        "r_lo",
        "s_lo",
        hundredths(at.r).alias("m_r"),
        theta_bin(slug.theta).alias("m_theta"),
        phi_bin(slug.phi).alias("m_phi"),
    )


def cut(sl: Slice, scope: Scope) -> tuple[Slice, Slice] | None:
    """Two halves of a slice along time; None once it spans a few microseconds."""
    if sl.end is None:
        since = sl.start - scope.begin
        reach = 2 * max(since, (scope.last_fired - scope.begin) / 2, 1.0)
        if reach > 1e12:
            return None
        middle = scope.begin + reach
    else:
        if sl.end - sl.start <= 4e-6:
            return None
        middle = (sl.start + sl.end) / 2
    return Slice(sl.start, middle), Slice(middle, sl.end)


def edges_within(
    rocks: DataFrame, slugs: DataFrame, sl: Slice, scope: Scope, budget: float, fold: bool = False
) -> DataFrame | None:
    """Class edges of a slice, or None if it should be cut first.

    ``rocks`` and ``slugs`` carry ``launch``. Bearings alone are tried first;
    the radius grid only where they leave too many candidates. A slice that
    cannot be cut further is joined whatever its size.
    """
    if not fold and unfolded(scope, budget):
        return class_edges(keyed_by_course(rocks, slugs, scope), Bound(0.0, 0.0), sl, scope)
    r_classes = launch_classes(rocks, TRACK_FIELDS)
    s_classes = launch_classes(slugs, SHOT_FIELDS)
    for grid in (False, True):
        k = keyed(r_classes, s_classes, sl, scope, grid)
        bound = pair_bound(k)
        if bound.pairs <= budget or (grid and cut(sl, scope) is None):
            return class_edges(k, bound, sl, scope)
    return None


def edges_between(
    rocks: DataFrame, slugs: DataFrame, sl: Slice, scope: Scope, budget: float, fold: bool = False
) -> DataFrame | None:
    """Class edges of all of a slice, which is cut where it has too many candidates; None without any.

    ``fold``: launches are of classes even where all pairs would be within the budget.
    """
    todo, found = [sl], None
    while todo:
        part = todo.pop()
        edges = edges_within(rocks, slugs, part, scope, budget, fold)
        if edges is None:
            todo.extend(reversed(cut(part, scope)))
            continue
        found = edges if found is None else found.unionByName(edges)
    return found


def unfolded(scope: Scope, budget: float) -> bool:
    """Even all pairs are within the budget: no need to fold copies or to count."""
    return float(scope.rocks) * scope.slugs <= min(budget, 4.0 * _CELL_PAIRS)


def default_budget(scope: Scope) -> float:
    """Candidate pairs one slice may test: linear in the number of objects."""
    return max(20e6, 16.0 * (scope.rocks + scope.slugs))


def expand(edges: DataFrame, rocks: DataFrame, slugs: DataFrame, *others: str) -> DataFrame:
    """Object pairs (rock, slug, t and others) of class edges."""
    r = rocks.select(F.col("launch").alias("r_launch"), F.col("id").alias("rock"))
    s = slugs.select(F.col("launch").alias("s_launch"), F.col("id").alias("slug"))
    return edges.join(r, "r_launch").join(s, "s_launch").select("rock", "slug", "t", *others)


def in_lists(placed: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Members (id, place) per ``keys``, in lists of at most LIST."""
    part = F.floor((F.col("place") - 1) / LIST).alias(f"{p}_part")
    return placed.groupBy(*keys, part).agg(F.collect_list(F.struct("id", "place")).alias(f"{p}_list"))


def member_lists(objects: DataFrame, p: str) -> DataFrame:
    """Classes with their members and the place of each in its class by id, in lists."""
    members = objects.select("id", F.col("launch").alias(f"{p}_launch"))
    placed = ranked(members, [f"{p}_launch"], ["id"], id_chunk("id"), "place")
    return in_lists(placed, [f"{p}_launch"], p)


def tasks_for(edges: DataFrame) -> int:
    """Tasks that class edges take to be made into object pairs, from counts alone."""
    pairs = edges.agg(F.sum(F.col("r_n").cast("double") * F.col("s_n"))).first()[0] or 0.0
    return int(pairs // TASK_PAIRS) + 1


def spread(blocks: DataFrame, tasks: int) -> DataFrame:
    """Object pairs of class edges with lists of both sides' members, dealt by block over ``tasks`` tasks.

    A block has at most LIST x LIST pairs, so tasks are even however large a class is, and pairs are formed after the last shuffle.
    """
    rest = [c for c in blocks.columns if c not in ("r_list", "s_list")]
    return (
        blocks.repartition(tasks, "r_launch", "s_launch", "r_part", "s_part")
        .select(*rest, "s_list", F.explode("r_list").alias("_r"))
        .select(*rest, "_r", F.explode("s_list").alias("_s"))
        .withColumns(
            {
                "rock": F.col("_r.id"),
                "slug": F.col("_s.id"),
                "rock_place": F.col("_r.place"),
                "slug_place": F.col("_s.place"),
            }
        )
        .drop("_r", "_s")
    )


def expand_evenly(edges: DataFrame, rocks: DataFrame, slugs: DataFrame, *others: str) -> DataFrame:
    """As ``expand``, for written edges of however many pairs."""
    tasks = tasks_for(edges)
    if tasks == 1:
        return expand(edges, rocks, slugs, *others)
    blocks = edges.join(member_lists(rocks, "r"), "r_launch").join(member_lists(slugs, "s"), "s_launch")
    return spread(blocks, tasks).select("rock", "slug", "t", *others)


def candidate_edges(
    rocks: DataFrame, slugs: DataFrame, budget: float | None = None
) -> DataFrame:
    """Every (rock, slug, t) with no miss reason."""
    scope = scope_of(rocks, slugs)
    if scope is None:
        return no_edges(rocks)
    limit = default_budget(scope) if budget is None else budget
    fold = not unfolded(scope, limit)
    rocks = with_launch(rocks, TRACK_FIELDS, fold)
    slugs = with_launch(slugs, SHOT_FIELDS, fold)
    found = edges_between(rocks, slugs, Slice(scope.begin, None), scope, limit)
    return expand_evenly(settle(found, "edges"), rocks, slugs) if fold else single_pairs(found)


def single_pairs(edges: DataFrame) -> DataFrame:
    """Object pairs of edges between classes of one."""
    return edges.select(F.col("r_lo").alias("rock"), F.col("s_lo").alias("slug"), "t")


def no_edges(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "rock long, slug long, t double")
