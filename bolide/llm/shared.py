"""What the corpus operators share: numbered rows, byte words and hashes.

A *word* is a run of bytes ``0-9``, ``a-z`` (``A-Z`` lower-cased) or any byte of
a non-ASCII character; everything else separates words. Words are found and
hashed with numpy over the Arrow buffers of a whole batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bolide.plans.settle import settle

_LENGTH = np.uint64(0x9E3779B97F4A7C15)
# Bytes hashed at a time: bounds the arrays of positions and sums.
SLICE = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def send(spark: SparkSession, value) -> Callable:
    """Broadcast a bounded ``value``, classes of this package by value; call the result in a task."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """Write the rows once as ``_doc`` (a struct of all columns) and ``_row`` (a number).

    The number is read back from the written table, so every later use of it
    sees the same one, also after a lost executor. Column names of ``docs``
    can't clash with ours, as they stay inside the struct.
    """
    packed = docs.select(F.struct("*").alias("_doc")).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    return settle(packed, label)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words, so that all bits look random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _word_bytes() -> np.ndarray:
    low = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or "0" <= c <= "9" or "a" <= c <= "z":
            low[b] = b
        elif "A" <= c <= "Z":
            low[b] = b + 32
    return low


LOWERED = _word_bytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes in a row and each value's offset in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(column) == 0:
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of ``column`` (one row at least)."""
    offsets = text_bytes(batch[column])[1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


class Words:
    """The words of a batch: ``low`` bytes, ``start``/``end`` of each word, ``per_doc`` counts."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = text_bytes(column)
        self.raw, self.low = raw, LOWERED[raw]
        inside = self.low > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        # A word ends with its document even where the next one begins with a word.
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.per_doc = np.diff(self.bounds)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_doc)), self.per_doc)

    def spelled(self) -> pa.Array:
        """The words themselves, lower-cased."""
        letters = self.low[self.low > 0]
        at = np.append(0, np.cumsum(self.end - self.start)).astype(np.int64)
        return pa.Array.from_buffers(
            pa.large_binary(), len(self), [None, pa.py_buffer(at), pa.py_buffer(letters)]
        )

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, found once."""
        if self._hashes is None:
            self._hashes = self.hashed([None])[0]
        return self._hashes

    def hashed(self, prefixes: list[int | None]) -> list[np.ndarray]:
        return span_hashes(self.low, self.start, self.end, prefixes)


def span_hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: list[int | None]
) -> list[np.ndarray]:
    """Per entry of ``prefixes`` a hash of each span's first so many bytes (0 if it is shorter), None: of all.

    Spans are in order and don't overlap; they are taken in runs of about ``SLICE`` bytes. Each byte gives
    a random-looking number for itself and its place in the span; a hash is their sum and the length,
    scrambled. So neither a zero byte nor a regular change of bytes goes unseen.
    """
    out = [np.empty(len(start), np.uint64) for _ in prefixes]
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + SLICE, "right")))
        s, size = start[a:b], end[a:b] - start[a:b]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        of_byte = data[np.repeat(s, size) + place].astype(np.uint64)
        sums = np.zeros(len(place) + 1, np.uint64)
        np.cumsum(mixed((place.astype(np.uint64) << np.uint64(8) | of_byte) + np.uint64(1)), out=sums[1:])
        for k, prefix in enumerate(prefixes):
            n = size if prefix is None else np.minimum(size, prefix)
            part = mixed(sums[first + n] - sums[first] + n.astype(np.uint64) * _LENGTH)
            if prefix is not None:
                part[size < prefix] = 0
            out[k][a:b] = part
        a = b
    return out


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by the checksum of the id's text (null: of no text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int
) -> DataFrame:
    """Texts to learn from: ``text``, ``label``, ``turn`` (their order by hash).

    At most ``rows`` documents with a known label that are not held out, in the order of a
    hash of their id; a text that would take the sample over ``size`` bytes is passed over. Where an id is
    labelled twice the larger label counts, and of several texts of one id the first in order.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    turn = F.xxhash64("doc_id", F.lit(label))
    chosen = F.broadcast(known.withColumn("turn", turn).orderBy("turn", "doc_id").limit(rows))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    found = found.groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").alias("label"), F.first("turn").alias("turn")
    )
    sizes = found.select("doc_id", "turn", F.octet_length("text").alias("n"))
    total, taken = 0, []
    for r in sizes.orderBy("turn", "doc_id").collect():  # three numbers for each of at most ``rows``
        if total + r["n"] <= size:
            total += r["n"]
            taken.append((r["doc_id"],))
    spark = docs.sparkSession
    kept = spark.createDataFrame(taken, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]))
    return found.join(F.broadcast(kept), "doc_id", "left_semi").select("text", "label", "turn")
