"""Fragments of hit rocks, and the cascade of further hits they cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.functions.numeric import PI, halved, roman, round_away
from bolide.functions.position import SHOT_FIELDS, TRACK_FIELDS, shot, shot_pos
from bolide.operators.matching import match_edges, merged, recounted, without
from bolide.operators.pairing import (
    Scope,
    Slice,
    cut,
    default_budget,
    edges_between,
    edges_within,
    no_edges,
    scope_of,
    unfolded,
    with_launch,
)
from bolide.operators.views import hit_details
from bolide.plans.settle import settle

# Ids of generation g are the root's id plus g times this.
GENERATION_STEP = 10**12
# The root's id and the generation number form a stable key of a fragment.
FAMILY = ["id", "name", "mass", "target", *TRACK_FIELDS, "root_id", "root_name", "generation"]


def fragment_id(root_id: Column, generation: Column) -> Column:
    """A root's id and a generation as one number; fails for roots whose numbers could meet others'."""
    fits = (root_id >= 0) & (root_id < GENERATION_STEP)
    wrong = F.raise_error(F.concat(F.lit("rock id outside 0 .. 10^12 - 1: "), root_id.cast("string")))
    return F.when(fits, root_id + generation * F.lit(GENERATION_STEP)).otherwise(wrong.cast("long"))


def with_family(rocks: DataFrame) -> DataFrame:
    """Original rocks as generation 0 of their own family."""
    if "generation" in rocks.columns:
        return rocks.select(*FAMILY)
    return rocks.withColumns(
        {
            "root_id": F.col("id"),
            "root_name": F.col("name"),
            "generation": F.lit(0).cast("long"),
        }
    ).select(*FAMILY)


def fragments(
    hits: DataFrame,
    rocks: DataFrame,
    slugs: DataFrame,
    rule: str = "reference",
    epoch_s: float = 0.0,
) -> DataFrame:
    """The fragment of each hit rock with a mass above 1.

    Half the mass and half the slopes, launched at the hit from one unit beyond
    the hit's r. ``rule`` sets the bearing at launch:

    * ``reference``: intercepts shifted by the absolute hit time (``epoch_s`` is
      the absolute time of second 0), phi by half its own intercept;
    * ``continuous``: the bearing the parent had when it was hit.
    """
    if rule not in ("reference", "continuous"):
        raise ValueError(f"unknown fragment rule {rule!r}")
    family = with_family(rocks)
    heavy = family.filter(F.col("mass") > 1)
    s = slugs.select(F.col("id").alias("slug"), *[F.col(c).alias(f"s_{c}") for c in SHOT_FIELDS])
    at = hits.join(s, "slug").select(
        F.col("rock").alias("id"),
        "t",
        round_away(shot_pos(shot("s_"), F.col("t")).r, 2).alias("pos_r"),
    )
    j = heavy.join(at, "id")
    t = F.col("t")
    if rule == "reference":
        clock = F.lit(float(epoch_s)) + t
        b_theta = F.col("b_theta") + F.col("m_theta") / 2 * clock
        b_phi = F.col("b_phi") + F.col("b_phi") / 2 * clock
    else:
        age = t - F.col("fired_s")
        b_theta = F.col("m_theta") * age + F.col("b_theta")
        b_phi = F.col("m_phi") * age + F.col("b_phi")
    born = F.col("generation") + 1
    return j.select(
        fragment_id(F.col("root_id"), born).alias("id"),
        F.concat(F.col("root_name"), F.lit(" "), roman(born)).alias("name"),
        halved(F.col("mass")).alias("mass"),
        F.lit(None).cast("string").alias("target"),
        t.alias("fired_s"),
        (F.col("m_theta") / 2).alias("m_theta"),
        b_theta.alias("b_theta"),
        (F.col("m_phi") / 2).alias("m_phi"),
        b_phi.alias("b_phi"),
        (F.col("pos_r") + 1).alias("r_0"),
        F.col("v").alias("v"),
        F.col("root_id"),
        F.col("root_name"),
        born.alias("generation"),
    )


def cascade(
    rocks: DataFrame,
    slugs: DataFrame,
    rule: str = "reference",
    epoch_s: float = 0.0,
    budget: float | None = None,
    since: tuple[float, DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(hits, fragments) once every fragment has met what it meets.

    One sweep over time slices of bounded work (``budget`` candidate pairs). A slice pairs its free rocks
    and slugs once; it is matched again only until the fragments born in it are stable, each time from
    the earliest fragment that changed, as a fragment meets slugs from its launch on. Then its
    hits are final and what is left of rocks, slugs and fragments goes on to the next slice; no slice is read twice.

    ``since`` = (time, hits, fragments) gives an earlier answer of which all
    hits before that time are known to stand.
    """
    free = settle(with_family(rocks), "rocks")
    hits, born, start = [], [], None
    if since is not None:
        start, old_hits, old_fragments = since
        early = settle(old_hits.filter(F.col("t") < start).select("rock", "slug", "t"), "hits")
        known = settle(old_fragments.filter(F.col("fired_s") < start).select(*FAMILY), "fragments")
        hits, born = [early], [known]
        free = settle(without(free.unionByName(known), early, "rock"), "rocks")
        slugs = settle(without(slugs, early, "slug"), "slugs")
    scope = scope_of(free, slugs)
    todo = []
    if scope is not None:
        todo = [Slice(scope.begin if start is None else max(scope.begin, start), None)]
    limit = None if scope is None else default_budget(scope) if budget is None else budget
    fold = scope is not None and not unfolded(scope, limit)
    while todo:
        sl = todo.pop()
        r, s = with_launch(free, TRACK_FIELDS, fold), with_launch(slugs, SHOT_FIELDS, fold)
        edges = edges_within(r, s, sl, scope, limit)
        if edges is None:
            todo.extend(reversed(cut(sl, scope)))
            continue
        found, made = _stable(edges, free, slugs, sl, scope, limit, fold, rule, epoch_s)
        hits.append(found)
        born.append(made)
        if todo:
            free = settle(without(free.unionByName(made), found, "rock"), "rocks")
            slugs = settle(without(slugs, found, "slug"), "slugs")
    if not hits:
        empty = free.limit(0)
        return no_edges(free), empty
    return _union(hits), _union(born)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _stable(
    edges: DataFrame,
    rocks: DataFrame,
    slugs: DataFrame,
    sl: Slice,
    scope: Scope,
    limit: float,
    fold: bool,
    rule: str,
    epoch_s: float,
) -> tuple[DataFrame, DataFrame]:
    """Hits of a slice and the fragments that they make, in agreement with each other."""
    edges = settle(edges, "edges")
    early, known, start = None, None, sl.start
    while True:
        objects, free_slugs = rocks if known is None else rocks.unionByName(known), slugs
        later = edges
        if early is not None:
            # Hits before the earliest fragment that changed stand; their rocks and slugs are out.
            objects, free_slugs = without(objects, early, "rock"), without(slugs, early, "slug")
        r, s = with_launch(objects, TRACK_FIELDS, fold), with_launch(free_slugs, SHOT_FIELDS, fold)
        if known is not None:
            r, s = settle(r, "rocks"), settle(s, "slugs")
            bits = with_launch(known, TRACK_FIELDS, fold).join(early.select(F.col("rock").alias("id")), "id", "left_anti")
            late = Slice(start, sl.end)
            fresh = edges_between(bits, s, late, scope, limit)
            later = edges.filter(F.col("t") >= start)
            later = recounted(later if fresh is None else later.unionByName(fresh), r, s)
            later = settle(merged(later) if fold else later, "edges")
        hits = match_edges(later, r, s)
        every = hits if early is None else early.unionByName(hits)
        everyone = rocks if known is None else rocks.unionByName(known)
        born = settle(fragments(every, everyone, slugs, rule, epoch_s), "fragments")
        changed = _first_change(known, born)
        if changed is None:
            return settle(every, "hits") if early is not None else hits, born
        early = settle(every.filter(F.col("t") < changed), "hits")
        known, start = born, changed


def _first_change(known: DataFrame | None, born: DataFrame) -> float | None:
    """Launch of the earliest fragment that is in one of the tables only."""
    if known is None:
        return born.agg(F.min("fired_s")).first()[0]
    both = known.withColumn("_n", F.lit(1)).unionByName(born.withColumn("_n", F.lit(-1)))
    moved = both.groupBy(*FAMILY).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return moved.agg(F.min("fired_s")).first()[0]


def family_sizes(rocks: DataFrame) -> DataFrame:
    """Members per family, the original included."""
    return rocks.groupBy("root_name").agg(F.count(F.lit(1)).alias("members"))


def family_by_prefix(rocks: DataFrame, prefix: str) -> DataFrame:
    return rocks.filter(F.col("name").startswith(prefix))


def descendants(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that fall with ``ids``: the closure along ``links`` (id, source: long; a null source is a root).

    Pointers are doubled: after k rounds each row knows its ancestor 2^k links up, and whether one of the
    given ids lies between. Links of any depth take a logarithm of it in rounds; one in a circle raises an error.
    """
    gone = ids.select(F.col("id").alias("source")).distinct().withColumn("_hit", F.lit(True))
    at = links.select("id", "source").join(gone, "source", "left")
    at = settle(at.select("id", "source", F.coalesce("_hit", F.lit(False)).alias("falls")), "lineage")
    rounds = 0
    while not at.filter("source is not null").isEmpty():
        if rounds > 62:
            raise ValueError("lineage has a circle")
        up = at.select(F.col("id").alias("source"), F.col("source").alias("_up"), F.col("falls").alias("_above"))
        at = at.join(up, "source", "left").select(
            "id",
            F.col("_up").alias("source"),
            (F.col("falls") | F.coalesce("_above", F.lit(False))).alias("falls"),
        )
        at = settle(at, "lineage")
        rounds += 1
    return at.filter("falls").select("id")


def lineage(rocks: DataFrame) -> DataFrame:
    """(id, source): each rock of a cascade's family tables and the rock it came from."""
    parent = fragment_id(F.col("root_id"), F.col("generation") - 1)
    return rocks.select("id", F.when(F.col("generation") > 0, parent).alias("source"))


def cascading_delete(rocks: DataFrame, ids: DataFrame) -> DataFrame:
    """``rocks`` (with families) without the given ones and all that came from them."""
    fallen = descendants(lineage(rocks), ids).unionByName(ids.select("id"))
    return rocks.join(fallen, "id", "left_anti")


def static_fragments(firsts: DataFrame, rocks: DataFrame, slugs: DataFrame) -> DataFrame:
    """Fixed breakup of each hit rock into pairs of mass-1 pieces.

    The mass left halves and the bearing nudge doubles from level to
    level while more than 1 is left; each level yields one piece to either side.
    """
    at = hit_details(firsts, rocks, slugs).select("rock", "t", F.col("pos_r").alias("hit_r"))
    j = rocks.join(at, rocks.id == at.rock)
    # Levels: floor(log2(mass)) - 1 more after the first.
    last = F.greatest(F.lit(0), F.length(F.bin(F.col("mass"))) - 2)
    level = F.col("level")
    levels = j.withColumn("level", F.explode(F.sequence(F.lit(0), last)))
    factor = F.expr("shiftright(2, level)").cast("double")
    nudge = F.lit(PI) / 4 * F.pow(F.lit(2.0), level)
    sided = levels.withColumn("side", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    side = F.col("side")
    number = 2 * level + F.when(side > 0, 1).otherwise(2)
    return sided.select(
        F.col("rock"),
        number.cast("long").alias("piece"),
        F.concat(F.col("name"), F.lit(" "), roman(number)).alias("name"),
        F.lit(1).cast("long").alias("mass"),
        F.col("t").alias("fired_s"),
        (F.col("m_theta") * factor).alias("m_theta"),
        (F.col("b_theta") + side * nudge).alias("b_theta"),
        (F.col("m_phi") * factor).alias("m_phi"),
        (F.col("b_phi") + side * nudge).alias("b_phi"),
        F.col("hit_r").alias("r_0"),
        F.col("v").alias("v"),
    )


def as_rocks(pieces: DataFrame) -> DataFrame:
    """Static pieces as rocks; at most 128 pieces share a parent's id range. Fails for ids beyond 2^55."""
    fits = (F.col("rock") >= 0) & (F.col("rock") < 1 << 55) & (F.col("piece") < 128)
    wrong = F.raise_error(F.concat(F.lit("rock id outside 0 .. 2^55 - 1: "), F.col("rock").cast("string")))
    return pieces.withColumn("id", F.when(fits, F.col("rock") * 128 + F.col("piece")).otherwise(wrong.cast("long")))
