"""Versioned history: half-open periods, and the state at any past time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.plans.skew import as_of_join, ranked, with_next


def month_of(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def history_intervals(
    changes: DataFrame,
    key: str = "obj_id",
    at: str = "changed_at",
    seq: str = "seq",
    deleted: Column | None = None,
) -> DataFrame:
    """Each version with its period [valid_from, valid_to); the last one is open.

    Changes for which ``deleted`` holds end the version before them and are none themselves.
    """
    rest = [c for c in changes.columns if c not in (at, "valid_from")]
    spans = with_next(changes.select(*rest, at), [key], [at, seq], month_of(F.col(at)), at, "valid_to")
    spans = spans.withColumnRenamed(at, "valid_from")
    return spans if deleted is None else spans.filter(~F.coalesce(deleted, F.lit(False)))


def history_as_of(
    changes: DataFrame,
    when: Column,
    key: str = "obj_id",
    at: str = "changed_at",
    seq: str = "seq",
) -> DataFrame:
    """The version of each object that was current at ``when``.

    Straight from the feed: the filter reaches the scan, and the latest version
    is a partial aggregate, so no period needs to be built.
    """
    values = F.struct(*[c for c in changes.columns if c != key])
    return (
        changes.filter(F.col(at) <= when)
        .groupBy(key)
        .agg(F.max_by(values, F.struct(at, seq)).alias("_v"))
        .select(key, "_v.*")
    )


def current_at(intervals: DataFrame, when: Column) -> DataFrame:
    """Rows of a period table that hold at ``when``."""
    open_end = F.col("valid_to").isNull()
    return intervals.filter(
        (F.col("valid_from") <= when) & (open_end | (F.col("valid_to") > when))
    )


def history_as_of_join(
    probes: DataFrame, changes: DataFrame, probe_time: str, values: list[str]
) -> DataFrame:
    """For many (object, time) probes, the version current then."""
    return as_of_join(
        probes, changes, "obj_id", probe_time, "changed_at", "seq", values, month_of
    )


def opening_versions(table: DataFrame, start: Column) -> DataFrame:
    """Rows present when history begins hold from an hour before, open-ended."""
    return table.withColumn("valid_from", start - F.expr("interval 1 hour")).withColumn(
        "valid_to", F.lit(None).cast("timestamp")
    )


def changed_rows(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose contents differ from the old row of the same key."""
    rest = [c for c in new.columns if c != key]
    before = old.select(F.col(key), F.struct(*rest).alias("_old"))
    return (
        new.join(before, key)
        .filter(~F.struct(*rest).eqNullSafe(F.col("_old")))
        .drop("_old")
    )


def field_changes(
    changes: DataFrame,
    field: str,
    key: str = "obj_id",
    at: str = "changed_at",
    seq: str = "seq",
) -> DataFrame:
    """Versions whose ``field`` differs from the version before."""
    chunk = month_of(F.col(at))
    numbered = ranked(changes, [key], [at, seq], chunk, "_n")
    before = numbered.select(
        F.col(key), (F.col("_n") + 1).alias("_n"), F.col(field).alias(f"old_{field}")
    )
    return (
        numbered.join(before, [key, "_n"])
        .filter(F.col(field) != F.col(f"old_{field}"))
        .select(key, at, seq, f"old_{field}", F.col(field).alias(f"new_{field}"))
    )


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change feed between two states: rows to retract and rows to add."""
    gone = before.subtract(after).withColumn("op", F.lit("retract"))
    come = after.subtract(before).withColumn("op", F.lit("add"))
    return gone.unionByName(come)
