"""Version capture: each change closes the version before it and opens its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bolide.operators.history import history_intervals
from bolide.plans.settle import settle
from bolide.streaming.state import VersionedTables


class VersionKeeper:
    """``foreachBatch`` handler for a feed (key, at, seq, values...).

    A version is known by (key, at, seq). Open versions are kept per batch. A batch
    writes only the closed versions that it closes or whose period a late change
    of it cuts; of several records of one version the last committed one holds. A change of an
    old version's values replaces it. ``deleted`` names a boolean column of the feed that marks deletions:
    these end a version, and are kept, unseen in ``history``, so that later ones can fall before them.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        key: str,
        at: str,
        seq: str,
        deleted: str | None = None,
    ):
        self.key, self.at, self.seq, self.deleted = key, at, seq, deleted
        empty = spark.createDataFrame([], schema)
        kept = empty.withColumns({"valid_from": F.col(at), "valid_to": F.col(at)}).drop(at)
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
        self.columns = kept.columns
        self.tables = VersionedTables(spark, path, {"open": ddl, "closed": ddl})

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        tables, known = self.tables, [self.key, self.at, self.seq]
        rest = [c for c in batch.columns if c not in known]
        once = batch.groupBy(*known).agg(F.max(F.struct(*rest)).alias("v")).select(*known, "v.*")
        once = settle(once, "versions")
        since = once.groupBy(self.key).agg(F.min(self.at).alias("_since"))
        held = tables.read("open", tables.latest(before=batch_id))
        # Versions that end before the first change of their key stay as they are.
        closed = tables.read_all("closed", before=batch_id).join(since, self.key, "left_semi")
        closed = self._last(closed).join(since, self.key).filter(F.col("valid_to") >= F.col("_since"))
        closed = settle(closed.select(*self.columns), "versions")
        touched = held.join(since.select(self.key), self.key, "left_semi").unionByName(closed)
        feed = touched.withColumnRenamed("valid_from", self.at).drop("valid_to")
        feed = feed.join(once.select(*known), known, "left_anti").select(*batch.columns)
        spans = history_intervals(feed.unionByName(once.select(*batch.columns)), *known)
        spans = settle(spans.select(*self.columns), "versions")
        untouched = held.join(since.select(self.key), self.key, "left_anti")
        tables.write("closed", batch_id, spans.filter("valid_to is not null").exceptAll(closed))
        still = spans.filter("valid_to is null")
        tables.write("open", batch_id, untouched.unionByName(still))
        tables.commit(batch_id)

    def _last(self, records: DataFrame) -> DataFrame:
        """The last record of each closed version."""
        known = [self.key, "valid_from", self.seq]
        rest = [c for c in self.columns if c not in known]
        found = records.groupBy(*known).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
        return found.select(*known, "v.*").select(*self.columns)

    def history(self) -> DataFrame:
        """All versions of the committed batches, closed and open."""
        t = self.tables
        found = self._last(t.read_all("closed")).unionByName(t.read("open", t.latest()))
        if self.deleted is None:
            return found
        return found.filter(~F.coalesce(self.deleted, F.lit(False))).drop(self.deleted)
