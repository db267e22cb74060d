"""Conflict-constrained best-fit packing of documents into bins of ``CAPACITY`` words.

A document longer than a bin is cut: its full pieces fill bins of their own, the rest is packed
like any other. Two pieces in one bin must not share a source or a duplicate
cluster. Bins are ordered by their residual and carry one bitmap of what they hold; the
search starts at the smallest residual that is large enough and goes on to the next
ones until it meets a compatible bin: the tightest there is. A tree over the residuals
keeps the AND of the bitmaps below each node, so runs of bins that all conflict are passed
over at once.

Pieces are dealt by hash into groups of about ``GROUP_ROWS``, each packed by itself in one task, largest
piece first: neither a source nor a cluster decides the group, so no hot one can fill it.

Defined cases: a document without words (null, empty) gets one row without a bin. A null source
conflicts with nothing; clusters are equal texts, and null counts as empty. Repeated
rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bolide.llm.shared import Words, pieces
from bolide.plans.settle import settle

CAPACITY = 2048
GROUP_ROWS = 4096
PACKED = "_row long, bin string, start int"


class Bins:
    """Open bins by residual, with a tree of ANDed bitmaps (-1: no bin below)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [-1] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]
        self.residual: list[int] = []
        self.held: list[int] = []

    def _update(self, residual: int) -> None:
        both = -1
        for b in self.at[residual]:
            both &= self.held[b]
        node = self.size + residual
        self.tree[node] = both
        while node > 1:
            node >>= 1
            self.tree[node] = self.tree[2 * node] & self.tree[2 * node + 1]

    def tightest(self, need: int, mask: int) -> int | None:
        """The first bin of the smallest residual >= ``need`` that shares no bit with ``mask``."""
        # Nodes that cover the residuals from need on, from small to large.
        stack, node = [], self.size + need
        cover = [node]
        while node > 1:
            if node % 2 == 0:
                cover.append(node + 1)
            node >>= 1
        stack = cover[::-1]
        while stack:
            node = stack.pop()
            if self.tree[node] & mask or self.tree[node] == -1:
                continue
            if node >= self.size:
                for b in self.at[node - self.size]:
                    if not self.held[b] & mask:
                        return b
            else:
                stack += (2 * node + 1, 2 * node)
        return None

    def put(self, b: int | None, need: int, mask: int, capacity: int) -> int:
        """Put a piece into bin ``b`` or a new one; the bin's number."""
        if b is None:
            b = len(self.residual)
            self.residual.append(capacity)
            self.held.append(0)
        else:
            self.at[self.residual[b]].remove(b)
            self._update(self.residual[b])
        self.residual[b] -= need
        self.held[b] |= mask
        self.at[self.residual[b]].append(b)
        self._update(self.residual[b])
        return b


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """Bin and start of each (size, source, cluster), taken in the given order."""
    many = {c for c, n in Counter(i[2] for i in items).items() if n > 1}
    bits: dict[tuple, int] = {}
    bins, out = Bins(capacity), []
    for need, source, cluster in items:
        mask = 0
        if source is not None:
            mask |= bits.setdefault(("source", source), 1 << len(bits))
        if cluster in many:
            mask |= bits.setdefault(("cluster", cluster), 1 << len(bits))
        b = bins.put(bins.tightest(need, mask), need, mask, capacity)
        out.append((b, capacity - bins.residual[b] - need))
    return out


def counted(docs: DataFrame) -> DataFrame:
    """Write doc_id, source, cluster, n_words and a row number of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n = pa.array(Words(part["text"]).per_doc, pa.int64())
                ids = [part["doc_id"].cast(pa.int64()), part["source"].cast(pa.string()), part["cluster"]]
                yield pa.RecordBatch.from_arrays([*ids, n], ["doc_id", "source", "cluster", "n_words"])

    cluster = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", "source", cluster.alias("cluster"))
    rows = rows.mapInArrow(count, "doc_id long, source string, cluster string, n_words long")
    return settle(rows.withColumn("_doc", F.monotonically_increasing_id()), "counted")


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, n_words, bin and the piece's start in the bin."""
    rows = counted(docs)
    last = F.greatest(F.ceil(F.col("n_words") / capacity) - 1, F.lit(0)).cast("int")
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    size = F.least(F.col("n_words") - F.col("piece") * capacity, F.lit(capacity)).cast("int")
    cut = settle(cut.withColumn("size", size).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    part = cut.filter((F.col("size") > 0) & (F.col("size") < capacity))
    groups = max(1, math.ceil(part.count() / group_rows))
    grouped = part.select(
        F.pmod(F.xxhash64("_doc", "piece"), F.lit(groups)).alias("group"), "_row", "size", "source", "cluster"
    )

    def fill(group: pa.Table) -> pa.Table:
        items = sorted(
            zip(*(group[c].to_pylist() for c in ("size", "_row", "source", "cluster"))),
            key=lambda i: (-i[0], i[1]),
        )
        placed = best_fit([(i[0], i[2], i[3]) for i in items], capacity)
        name = group["group"][0].as_py()
        return pa.table(
            {
                "_row": pa.array([i[1] for i in items], pa.int64()),
                "bin": [f"{name}-{b}" for b, _ in placed],
                "start": pa.array([s for _, s in placed], pa.int32()),
            }
        )

    placed = grouped.groupBy("group").applyInArrow(fill, PACKED)
    full = F.when(
        F.col("size") == capacity, F.concat(F.lit("full-"), F.col("_doc"), F.lit("-"), F.col("piece"))
    )
    return (
        cut.join(placed, "_row", "left")
        .select(
            "doc_id",
            "piece",
            F.col("size").alias("n_words"),
            F.coalesce("bin", full).alias("bin"),
            F.coalesce("start", F.when(F.col("size") == capacity, 0)).alias("start"),
            "source",
            "cluster",
        )
    )
