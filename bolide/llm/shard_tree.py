"""Sharding by a hierarchical weighted hash tree.

A document walks down region, rack and shard. At each node every child draws
``-ln(u) / weight`` with ``u`` hashed from the document's id and the child's
name, and the smallest draw wins. A child's draws don't depend on its sisters, so
when one child's weight changes, documents only move into it (more weight) or
out of it (less): sister subtrees never exchange documents among themselves, and
inside a subtree whose weights are unchanged nobody moves.

Defined cases: null doc_ids draw alike and share one shard; repeated doc_ids
share theirs. A null text has size 1 and the checksum of the empty text. An empty
table gives no rows. Slots count from 0 in the order of (doc_id, nulls
first; place in the written table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bolide.plans.settle import settle

# Nested dicts: region -> rack -> shard number -> weight.
Tree = dict[str, dict[str, dict[int, float]]]

REGIONS, RACKS = 2, 2


def default_tree(shards: int, regions: int = REGIONS, racks: int = RACKS, base: int = 16) -> Tree:
    """``base`` shards of weight 1 over regions and racks; each further shard in a region of its own.

    A grown shard in its own region changes no existing subtree's weight, so
    growing by one moves documents only into the new shard.
    """
    tree: Tree = {}
    per_rack = max(1, base // (regions * racks))
    for shard in range(min(shards, base)):
        rack = min(shard // per_rack, regions * racks - 1)
        region = tree.setdefault(f"region{rack // racks}", {})
        region.setdefault(f"rack{rack}", {})[shard] = 1.0
    for shard in range(base, shards):
        tree[f"grown{shard}"] = {f"rack-grown{shard}": {shard: 1.0}}
    return tree


def _weight(node) -> float:
    return float(node) if not isinstance(node, dict) else sum(map(_weight, node.values()))


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def place(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Add ``out``, the shard number that ``key`` reaches; children of weight 0 get nothing.

    One column per level holds the path so far, so the expression of a level has one
    draw per child and is not repeated in the next.
    """
    if _weight(tree) <= 0:
        raise ValueError("the tree has no weight")
    level: dict[str, dict] = {"": tree}
    path = f"_path_{out}"
    df = df.withColumn(path, F.lit(""))
    while level:
        choice, below = F.lit(None).cast("string"), {}
        for name, node in level.items():
            alive = {f"{name}/{k}": child for k, child in node.items() if _weight(child) > 0}
            draws = [
                F.struct(_draw(F.col(key), k, _weight(child)).alias("draw"), F.lit(k).alias("path"))
                for k, child in alive.items()
            ]
            best = F.array_min(F.array(*draws))["path"] if len(draws) > 1 else F.lit(next(iter(alive)))
            choice = F.when(F.col(path) == name, best).otherwise(choice)
            below |= {k: child for k, child in alive.items() if isinstance(child, dict)}
        df, level = df.withColumn(path, choice), below
    return df.withColumn(out, F.substring_index(path, "/", -1).cast("int")).drop(path)


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and the shard in the ``grown`` tree (null without one)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = place(rows, "doc_id", tree, "shard")
    if grown:
        rows = place(rows, "doc_id", grown, "grown_shard")
    else:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    return with_slots(settle(rows, "sharded"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard without gaps, no task holding a whole shard.

    Rows are range-partitioned by (shard, doc_id, _row), a unique key, and
    written with their partition. A row's slot is its rank in its piece of the shard plus
    the sizes of the shard's earlier pieces: one small row per piece.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", "doc_id", "_row"]
    ranged = settle(
        rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    earlier = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("shard", "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(W.partitionBy("shard", "_part").orderBy("doc_id", "_row")) - 1
    return (
        ranged.withColumn("_local", local)
        .join(offsets, ["shard", "_part"])
        .withColumn("slot", (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_part", "_local", "_before", "_row")
    )
