"""Cut lineage by writing a table to the cluster's shared checkpoint folder.

Iterative operators write each round's state as parquet and read it back.
The files outlive executors, the next round's plan starts at a plain scan, and
the scan knows its size, so the join strategies chosen later rest on
measured sizes rather than on estimates through a long plan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Where the tables settled now are noted down, by the innermost ``noted`` block.
_NOTES: ContextVar[list[str] | None] = ContextVar("settled", default=None)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a session on one machine may go without the setting; it gets a
    fresh temporary folder.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    # Where the session only has its context's folder, use that.
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bolide-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame, label: str = "round") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/bolide/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    notes = _NOTES.get()
    if notes is not None:
        notes.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that are settled inside the block."""
    notes: list[str] = []
    token = _NOTES.set(notes)
    try:
        yield notes
    finally:
        _NOTES.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def apart(label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Settle what ``build`` returns, then delete the tables that it settled on its way.

    For operators with a small result: their intermediate tables go as soon as it is written.
    """
    with noted() as own:
        made = build()
        spark = made.sparkSession
        result = settle(made, label)
        kept = own.pop()
    release(spark, own)
    notes = _NOTES.get()
    if notes is not None:
        notes.append(kept)
    return result
