"""Exact dedup with a heavy-hitter split, JVM-side only.

A Misra-Gries sketch (``approx_top_k``, mergeable, map-side) finds the digests that
may be frequent. Their counts are then verified; the true heavy hitters, at most
``SHARE`` rows whatever the data, are broadcast and decide their copies
map-side. Only the other digests are shuffled, and none of these has more
than 1 / ``SHARE`` of all rows.

Defined cases: a null text counts as empty. A null doc_id comes after all
others. Rows that repeat both doc_id and text are told apart by their place in the
written table, so one row of a group stays. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.llm.shared import numbered
from bolide.plans.settle import settle

# A digest is heavy from 1 / SHARE of all rows on; so there are at most SHARE of them.
SHARE = 1024
# The sketch tracks more, so that its error stays below 1 / SHARE of all rows.
TRACKED = 4096


def text_digest(text: Column) -> Column:
    """SHA-256 (hex) of the text with each run of ASCII white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def heavy_winners(keys: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """Digests with at least 1 / ``share`` of all rows: digest, first, n. At most ``share`` rows."""
    total = keys.count()
    candidates = keys.agg(
        F.expr(f"approx_top_k(digest, {share}, {tracked})").alias("top")
    ).select(F.explode("top.item").alias("digest"))
    candidates = F.broadcast(settle(candidates, "candidates"))  # at most share rows
    verified = _groups(keys.join(candidates, "digest", "left_semi"))
    return settle(verified.filter(F.col("n") * share >= F.lit(total)), "winners")


def _groups(keys: DataFrame) -> DataFrame:
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_row")
    return keys.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))


def decisions(keys: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """For written ``keys`` (doc_id, _row, digest): keep_id, group_size and kept of each row."""
    winners = F.broadcast(heavy_winners(keys, share, tracked))
    heavy = keys.join(winners, "digest")
    light = keys.join(winners, "digest", "left_anti")
    both = heavy.unionByName(light.join(_groups(light), "digest"))
    return both.select(
        "doc_id",
        "_row",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("first._row") == F.col("_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """One row per document, dropped ones too, with the row that stays for it."""
    keys = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("_row"), text_digest(F.col("text")).alias("digest")
    )
    return decisions(settle(keys, "digests"), share, tracked).drop("_row")


def drop_copies(docs: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one of each group of equal texts."""
    rows = numbered(docs, "exact")
    keys = settle(
        rows.select(
            F.col("_doc.doc_id").alias("doc_id"), "_row", text_digest(F.col("_doc.text")).alias("digest")
        ),
        "digests",
    )
    gone = decisions(keys, share, tracked).filter("not kept").select("_row")
    return rows.join(gone, "_row", "left_anti").select("_doc.*")
