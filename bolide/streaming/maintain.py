"""Hits kept up to date under a stream of changes to rocks and slugs.

A micro-batch of upserts and deletes is added to the tables' logs, the earliest
meeting that any changed object has or had is found, and only hits from that
time on are matched again: earlier hits cannot change. The differences come out
as a feed of retracted and added hits, since a late or faster slug may take
back an earlier answer. They are also all that is written of the hits and fragments, so the
bytes that a batch writes follow its changes and not the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bolide.functions.position import SHOT_FIELDS, TRACK_FIELDS
from bolide.operators.fragments import FAMILY, cascade, with_family
from bolide.operators.history import diff
from bolide.operators.pairing import candidate_edges
from bolide.plans.settle import settle
from bolide.streaming.counted import CountedViews
from bolide.streaming.state import DeltaTables

_TRACK = ", ".join(f"{c} double" for c in TRACK_FIELDS)
ROCKS = f"id long, name string, mass long, target string, {_TRACK}"
SLUGS = "id long, name string, target string, " + ", ".join(f"{c} double" for c in SHOT_FIELDS)
HITS = "rock long, slug long, t double"
FRAGMENTS = (
    f"id long, name string, mass long, target string, {_TRACK},"
    " root_id long, root_name string, generation long"
)
FEED = HITS + ", op string"
# Change records: kind is rock or slug, op is upsert or delete, seq orders versions.
CHANGES = (
    "seq long, kind string, op string, id long, name string, mass long, target string,"
    f" {_TRACK}, theta double, phi double"
)


class HitKeeper:
    """``foreachBatch`` handler that maintains rocks, slugs, hits and fragments."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        rule: str = "reference",
        epoch_s: float = 0.0,
        buckets: int = 16,
        compact_every: int = 16,
        views: CountedViews | None = None,
    ):
        """``views`` are kept along, over the feeds ``hits`` and ``fragments``."""
        self.views = views
        schemas = {"rocks": ROCKS, "slugs": SLUGS, "hits": HITS, "fragments": FRAGMENTS}
        keys = {"rocks": "id", "slugs": "id", "hits": "rock", "fragments": "id"}
        self.tables = DeltaTables(spark, path, schemas, keys, buckets, compact_every)
        self.spark, self.path = spark, path
        self.rule, self.epoch_s = rule, epoch_s

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        tables = self.tables
        before = tables.latest(before=batch_id)
        old = {name: tables.read(name, before) for name in ("rocks", "slugs", "hits", "fragments")}
        latest = settle(_latest(batch), "changes")
        moves: dict[str, DataFrame | None] = {"rocks": None, "slugs": None}
        kinds = {r["kind"] for r in latest.select("kind").distinct().collect()}
        for kind, name in (("rock", "rocks"), ("slug", "slugs")):
            if kind not in kinds:
                continue
            mine = latest.filter(F.col("kind") == kind)
            held = settle(tables.read(name, before, keys=mine.select("id")), "held")
            new, gone, moves[name] = _applied(held, mine)
            tables.write(name, batch_id, new, gone)
        rocks, slugs = (tables.read(name, before, batch_id) for name in ("rocks", "slugs"))
        since = self._first_affected(old, rocks, slugs, moves["rocks"], moves["slugs"])
        feeds = {"hits": self.spark.createDataFrame([], FEED)}
        if since is not None:
            hits, fragments = cascade(
                rocks,
                slugs,
                self.rule,
                self.epoch_s,
                since=(since, old["hits"], old["fragments"]),
            )
            feeds["hits"] = diff(old["hits"], hits.select("rock", "slug", "t"))
            feeds["fragments"] = diff(old["fragments"], fragments.select(*FAMILY))
        written = {}
        for name, feed in feeds.items():
            # The hits' feed is kept for readers, the other only until its delta is written.
            where = f"{self.path}/{name}-feed/batch={batch_id}"
            feed.write.mode("overwrite").parquet(where)
            feed = self.spark.read.schema(feed.schema).parquet(where)
            if since is not None:
                tables.write(name, batch_id, feed.filter("op = 'add'").drop("op"), feed.filter("op = 'retract'"))
            written[name] = feed
        if self.views is not None:
            self.views(written, batch_id)
        tables.commit(batch_id)

    def feed(self, batch: int | None = None) -> DataFrame:
        """Retracted and added hits of a committed batch, by default the last."""
        batch = self.tables.latest() if batch is None else batch
        return self.spark.read.schema(FEED).parquet(f"{self.path}/hits-feed/batch={batch}")

    def _first_affected(
        self,
        old: dict[str, DataFrame],
        rocks: DataFrame,
        slugs: DataFrame,
        rock_moves: DataFrame | None,
        slug_moves: DataFrame | None,
    ) -> float | None:
        """Earliest meeting of any old or new version of a changed object.

        None when nothing changed hands: then the old answer stands.
        """
        earliest = []
        if rock_moves is not None and not rock_moves.isEmpty():
            partners = _both(old["slugs"], slugs)
            earliest.append(_first_meeting(rock_moves, partners))
        if slug_moves is not None and not slug_moves.isEmpty():
            partners = _both(with_family(old["rocks"]), with_family(rocks))
            partners = partners.unionByName(old["fragments"].select(*partners.columns))
            earliest.append(_first_meeting(partners, slug_moves))
        times = [t for t in earliest if t is not None]
        return min(times) if times else None


def _latest(batch: DataFrame) -> DataFrame:
    """The last change per object, aggregated before it is shuffled."""
    rest = [c for c in batch.columns if c not in ("kind", "id")]
    return (
        batch.groupBy("kind", "id")
        .agg(F.max_by(F.struct(*rest), "seq").alias("v"))
        .select("kind", "id", "v.*")
    )


def _applied(held: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to write, ids to delete, and the old and new versions of rows that really change.

    ``held``: the stored rows of the changed ids. An upsert that equals its stored row is no change.
    """
    upserts = changes.filter(F.col("op") == "upsert").select(*held.columns)
    deleted = changes.filter(F.col("op") == "delete").select("id")
    new = settle(upserts.subtract(held), "changed")
    gone = held.join(deleted, "id", "left_semi")
    stale = held.join(new.select("id"), "id", "left_semi")
    moves = settle(new.unionByName(stale).unionByName(gone), "moves")
    return new, gone.select("id"), moves


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def _first_meeting(rocks: DataFrame, slugs: DataFrame) -> float | None:
    return candidate_edges(rocks, slugs).agg(F.min("t")).first()[0]


def keep_hits(changes: DataFrame, keeper: HitKeeper, checkpoint: str):
    """A writer that maintains the hits from a stream of change records; start it."""
    return (
        changes.writeStream.foreachBatch(keeper)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def launch(records: DataFrame, path: str) -> DataFrame:
    """Append launches that carry their ids and return the ids to look up."""
    records.write.mode("append").parquet(path)
    return records.select("id")


def look_up(active: DataFrame, kind: str, ids: DataFrame) -> DataFrame:
    """Rows of the active view for given ids."""
    return active.filter(F.col("type") == kind).join(ids, "id", "left_semi")
