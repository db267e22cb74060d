"""Ranks and broadcasts that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows below which a side may be broadcast; callers count before they ask.
BROADCAST_ROWS = 200_000


def _matches(keys: list[str]) -> tuple[list[Column], Column]:
    """Renamed keys for a side table, and the null-safe condition that joins it."""
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return renamed, condition


def ranked(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str
) -> DataFrame:
    """``row_number`` per key without sorting a whole key in one task.

    ``chunk`` cuts each key's rows into pieces that follow the order (it must
    be a non-decreasing function of ``order``). Rows are numbered inside their
    (key, chunk), and the counts of earlier chunks, one small row per chunk,
    are added as an offset.
    """
    pieces = df.withColumn("_chunk", chunk)
    renamed, same = _matches(keys)
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *renamed,
            F.col("_chunk").alias("_c"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    local = F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(*order))
    return (
        pieces.withColumn("_local", local)
        .join(offsets, same & F.col("_chunk").eqNullSafe(F.col("_c")))
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("long"))
        .select(*df.columns, out)
    )


def total_before(
    df: DataFrame, keys: list[str], order: str, chunk: Column, value: str, out: str
) -> DataFrame:
    """Sum of ``value`` over the key's rows of lower ``order``, in pieces as ``ranked``.

    ``order`` must not repeat within a key.
    """
    pieces = df.withColumn("_chunk", chunk)
    renamed, same = _matches(keys)
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*keys, "_chunk")
        .agg(F.sum(value).alias("_n"))
        .select(
            *renamed,
            F.col("_chunk").alias("_c"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        )
    )
    near = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        pieces.withColumn("_local", F.coalesce(F.sum(value).over(near), F.lit(0)))
        .join(offsets, same & F.col("_chunk").eqNullSafe(F.col("_c")))
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .select(*df.columns, out)
    )


def id_chunk(name: str, width: int = 1 << 20) -> Column:
    """Chunk of a unique integer id: at most ``width`` rows per chunk."""
    return F.floor(F.col(name) / F.lit(width))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count proves it small, else leave the choice to Spark.

    The count stops at ``rows`` + 1, so asking is cheap for large inputs.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def with_next(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, out: str
) -> DataFrame:
    """``lead(value)`` per key, with no task holding a whole key.

    Rows look ahead inside their (key, chunk); the last row of a chunk takes the
    first value of the key's next chunk from one small row per chunk. ``value``
    must not be null. Key and chunk are one struct, in which nulls are equal, so rows that were dealt out and sorted
    to look ahead meet these small rows where they are.
    """
    piece = F.struct(*keys, "_chunk").alias("_piece")
    ahead = W.partitionBy(*keys).orderBy("_chunk")
    head = F.min(value) if value == order[0] else F.min_by(value, F.struct(*order))
    heads = (
        df.withColumn("_chunk", chunk)
        .groupBy(*keys, "_chunk")
        .agg(head.alias("_head"))
        .select(piece, F.lead("_head").over(ahead).alias("_later"))
    )
    rest = [c for c in df.columns if c not in keys]
    pieces = df.withColumn("_chunk", chunk).select(piece, *rest)
    local = F.lead(value).over(W.partitionBy("_piece").orderBy(*order))
    return (
        pieces.withColumn("_near", local)
        .join(heads, "_piece")
        .withColumn(out, F.coalesce(F.col("_near"), F.col("_later")))
        .select(*[F.col(f"_piece.{c}").alias(c) if c in keys else F.col(c) for c in df.columns], out)
    )


def as_of_join(
    probes: DataFrame,
    versions: DataFrame,
    key: str,
    probe_time: str,
    version_time: str,
    seq: str,
    values: list[str],
    chunk,
) -> DataFrame:
    """For each probe, the values of its key's latest version at or before it.

    One sort of both sides together per (key, chunk); chunks before the
    probe's contribute one carried row each. ``chunk`` maps a time column to a
    piece number. Probes without a version keep nulls.
    """
    probe_cols = probes.columns
    v = versions.select(
        F.col(key),
        F.col(version_time).alias("_at"),
        F.lit(0).alias("_probe"),
        F.col(seq).alias("_seq"),
        F.struct(*values).alias("_version"),
        F.lit(None).cast(probes.select(F.struct(*probe_cols).alias("p")).schema["p"].dataType).alias("_row"),
    )
    p = probes.select(
        F.col(key),
        F.col(probe_time).alias("_at"),
        F.lit(1).alias("_probe"),
        F.lit(None).cast(versions.schema[seq].dataType).alias("_seq"),
        F.lit(None).cast(v.schema["_version"].dataType).alias("_version"),
        F.struct(*probe_cols).alias("_row"),
    )
    both = v.unionByName(p).withColumn("_chunk", chunk(F.col("_at")))
    near = (
        W.partitionBy(key, "_chunk")
        .orderBy("_at", "_probe", "_seq")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    earlier = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        both.groupBy(key, "_chunk")
        .agg(
            F.max_by(
                "_version", F.when(F.col("_probe") == 0, F.struct("_at", "_seq"))
            ).alias("_tail")
        )
        .select(
            F.col(key).alias("_k"),
            F.col("_chunk").alias("_c"),
            F.last("_tail", ignorenulls=True).over(earlier).alias("_carried"),
        )
    )
    found = F.coalesce(F.col("_near"), F.col("_carried"))
    return (
        both.withColumn("_near", F.last("_version", ignorenulls=True).over(near))
        .filter("_probe = 1")
        .join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_chunk").eqNullSafe(F.col("_c")))
        .withColumn("_found", found)
        .select(
            *[F.col(f"_row.{c}").alias(c) for c in probe_cols],
            *[F.col(f"_found.{c}").alias(c) for c in values],
        )
    )
