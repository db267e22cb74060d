"""Views of counts and sums, kept by signed changes instead of being computed anew."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bolide.plans.settle import settle
from bolide.streaming.state import DeltaTables


@dataclass(frozen=True)
class CountedView:
    """Rows of a feed counted by SQL expressions, with sums of whole-number expressions."""

    feed: str
    by: dict[str, str]
    sums: dict[str, str] = field(default_factory=dict)

    def signed(self, changes: DataFrame) -> DataFrame:
        """What a feed of rows with ``op`` retract or add changes in each group; a null adds nothing to a sum.

        Partial aggregates before the shuffle: a group with most of the changes costs one row a task.
        """
        sign = F.when(F.col("op") == "add", 1).when(F.col("op") == "retract", -1).cast("long")
        totals = {n: F.coalesce(F.expr(f"cast({e} as long)"), F.lit(0)) for n, e in self.sums.items()}
        group = F.struct(*[F.expr(e).alias(n) for n, e in self.by.items()])
        return changes.groupBy(group.alias("group")).agg(
            F.sum(sign).alias("n"), *[F.sum(sign * total).alias(name) for name, total in totals.items()]
        )


class CountedViews:
    """Keeps views up to date under feeds of retracted and added rows, batch by batch.

    A batch reads the buckets of the groups that it touches and writes only these groups; a group without rows
    is deleted. A batch that is replayed starts from the state before it, so it counts once. The result is
    that of counting the present rows, whatever way they came about. ``feeds`` gives the columns of each feed
    without ``op``. Null group values are a group of their own.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        views: dict[str, CountedView],
        feeds: dict[str, str],
        buckets: int = 16,
        compact_every: int = 16,
    ):
        self.views = views
        schemas = {}
        for name, view in views.items():
            changes = spark.createDataFrame([], f"{feeds[view.feed]}, op string")
            kept = view.signed(changes).schema.fields
            schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        self.tables = DeltaTables(spark, path, schemas, dict.fromkeys(views, "group"), buckets, compact_every)

    def __call__(self, feeds: dict[str, DataFrame], batch_id: int) -> None:
        """Take one batch of any of the feeds in and commit it."""
        before = self.tables.latest(before=batch_id)
        for name, view in self.views.items():
            if view.feed in feeds:
                self._take(name, view, feeds[view.feed], before, batch_id)
        self.tables.commit(batch_id)

    def _take(self, name: str, view: CountedView, feed: DataFrame, before: int | None, batch_id: int) -> None:
        numbers = ["n", *view.sums]
        moved = view.signed(feed).filter(" or ".join(f"`{c}` <> 0" for c in numbers))
        moved = settle(moved, "moved")
        held = self.tables.read(name, before, keys=moved)
        now = held.unionByName(moved).groupBy("group").agg(*[F.sum(c).alias(c) for c in numbers])
        now = settle(now, "counted")
        self.tables.write(name, batch_id, now.filter("n <> 0"), now.filter("n = 0"))

    def view(self, name: str) -> DataFrame:
        """A view after the last committed batch, one row per group."""
        return self.tables.current(name).select("group.*", "n", *self.views[name].sums)
