"""Tables kept across micro-batches, as whole versions or as logs of changed rows.

Each batch writes next to what is there, a complete new version (``VersionedTables``) or only the rows that it changes
(``DeltaTables``), and then a commit row. A batch that is replayed after a failure reads the state before it and
writes the same result again, so every batch takes effect once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bolide.plans.settle import release


class VersionedTables:
    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path, schemas

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("batch long").parquet(f"{self.path}/commits")
        except AnalysisException:
            return None

    def latest(self, before: int | None = None) -> int | None:
        """Last committed batch, optionally among those before a batch."""
        commits = self._commits()
        if commits is None:
            return None
        if before is not None:
            commits = commits.filter(F.col("batch") < before)
        return commits.agg(F.max("batch")).first()[0]

    def read(self, name: str, batch: int | None) -> DataFrame:
        """A table as of a committed batch; empty before the first one."""
        if batch is None:
            return self.spark.createDataFrame([], self.schemas[name])
        where = f"{self.path}/{name}/batch={batch}"
        return self.spark.read.schema(self.schemas[name]).parquet(where)

    def read_all(self, name: str, before: int | None = None) -> DataFrame:
        """What each committed batch, optionally among those before a batch, wrote, with ``batch``."""
        schema = f"{self.schemas[name]}, batch long"
        commits = self._commits()
        if commits is None:
            return self.spark.createDataFrame([], schema)
        if before is not None:
            commits = commits.filter(F.col("batch") < before)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows.join(commits, "batch", "left_semi").select(*rows.columns)

    def write(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return self.read(name, batch)

    def commit(self, batch: int) -> None:
        row = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"))
        row.write.mode("overwrite").parquet(f"{self.path}/commits/part={batch}")

    def current(self, name: str) -> DataFrame:
        """The table after the last committed batch."""
        return self.read(name, self.latest())


class DeltaTables:
    """Keyed tables as a base and a log of deltas, both in buckets of the key.

    A batch writes the rows that it changes and the keys that it deletes. After ``compact_every`` batches the
    state is written as a new base in the same batch; what the base before the last one was made of is deleted
    then, so a reader may be as late as the last but one base. A look-up of given keys
    reads their buckets only.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schemas: dict[str, str],
        keys: dict[str, str],
        buckets: int = 16,
        compact_every: int = 16,
    ):
        self.spark, self.path, self.schemas, self.keys = spark, path, schemas, keys
        self.buckets, self.compact_every = buckets, compact_every
        self.columns = {name: spark.createDataFrame([], ddl).columns for name, ddl in schemas.items()}
        # Bases of committed batches, which don't change any more.
        self._bases: dict[int, int | None] = {}

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema("batch long, base long").parquet(f"{self.path}/commits")
        except AnalysisException:
            return self.spark.createDataFrame([], "batch long, base long")

    def latest(self, before: int | None = None) -> int | None:
        """Last committed batch, optionally among those before a batch."""
        commits = self._commits()
        if before is not None:
            commits = commits.filter(F.col("batch") < before)
        return commits.agg(F.max("batch")).first()[0]

    def _base_of(self, batch: int | None) -> int | None:
        """The base that the state after a batch starts from."""
        if batch is None:
            return None
        if batch not in self._bases:
            self._bases = {batch: self._commits().filter(F.col("batch") == batch).agg(F.max("base")).first()[0]}
        return self._bases[batch]

    def _part(self, name: str, kind: str, extra: str) -> DataFrame:
        schema = f"{self.schemas[name]}, {extra}batch long, bucket int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{kind}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def read(
        self, name: str, batch: int | None, pending: int | None = None, keys: DataFrame | None = None
    ) -> DataFrame:
        """The table after a committed batch, and after the delta of a ``pending`` one; of given ``keys`` only.

        Empty before the first batch. ``keys`` has the key column.
        """
        key = self.keys[name]
        columns = self.columns[name]
        base = self._base_of(batch)
        old = self._part(name, "base", "").filter(F.col("batch") == F.lit(base))
        log = self._part(name, "delta", "gone boolean, ")
        since = F.lit(True) if base is None else F.col("batch") > base
        known = F.lit(False) if batch is None else (F.col("batch") <= batch) & since
        log = log.filter(known if pending is None else known | (F.col("batch") == pending))
        if keys is not None:
            # One number per bucket at most.
            some = [r[0] for r in keys.select(self._bucket(key)).distinct().collect()]
            old, log = (
                part.filter(F.col("bucket").isin(some)).join(keys.select(key), key, "left_semi") for part in (old, log)
            )
        rest = F.struct("gone", *[c for c in columns if c != key])
        last = log.groupBy(key).agg(F.max_by(rest, "batch").alias("_last")).select(key, "_last.*")
        held = old.select(*columns).join(last.select(key), key, "left_anti")
        return held.unionByName(last.filter("not gone").select(*columns))

    def write(self, name: str, batch: int, upserts: DataFrame, gone: DataFrame) -> None:
        """The delta of a batch: rows that are new or changed, and keys that are deleted."""
        key = self.keys[name]
        columns = self.columns[name]
        deleted = gone.select(key).join(upserts.select(key), key, "left_anti").distinct()
        rows = upserts.select(*columns).withColumn("gone", F.lit(False))
        rows = rows.unionByName(deleted.withColumn("gone", F.lit(True)), allowMissingColumns=True)
        self._store(rows, f"{name}/delta/batch={batch}", key)

    def _store(self, rows: DataFrame, where: str, key: str) -> None:
        rows = rows.withColumn("bucket", self._bucket(key))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{where}")

    def commit(self, batch: int) -> None:
        """End a batch; every ``compact_every`` batches the state becomes a new base first."""
        before = self.latest(before=batch)
        base = self._base_of(before)
        old = base
        done = self._commits().filter(F.col("batch") < batch)
        if base is not None:
            done = done.filter(F.col("batch") > base)
        due = done.count() + 1 >= self.compact_every
        if due:
            for name, key in self.keys.items():
                self._store(self.read(name, before, batch), f"{name}/base/batch={batch}", key)
            base = batch
        row = self.spark.createDataFrame([(batch, base)], "batch long, base long")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/part={batch}")
        if due and old is not None:
            self._expire(old)

    def _expire(self, old: int) -> None:
        """Delete the deltas up to the base ``old`` and the bases before it."""
        commits = self._commits().filter(F.col("batch") <= old)
        gone = [f"{n}/delta/batch={r['batch']}" for r in commits.collect() for n in self.keys]
        bases = {r["base"] for r in commits.collect() if r["base"] is not None and r["base"] < old}
        gone += [f"{n}/base/batch={b}" for b in bases for n in self.keys]
        release(self.spark, [f"{self.path}/{g}" for g in gone])
        # Their commits go last; nothing can read those states any more.
        last = [r["batch"] for r in commits.collect() if r["batch"] < old]
        release(self.spark, [f"{self.path}/commits/part={b}" for b in last])

    def current(self, name: str) -> DataFrame:
        """The table after the last committed batch."""
        return self.read(name, self.latest())
