"""Corpus-wide counts for the keys of a chunk of documents, without a row per key.

Documents are written as *chunks* of a few megabytes. A chunk's distinct keys (48-bit
hashes, sorted) go out as one packed array per key range; each range adds up the
counts of all chunks and sends every chunk the totals of its own keys, in the same order. So
a chunk gets exact totals over all documents, and what is shuffled is a few bytes per
distinct key of a chunk. The number of ranges follows the number of chunks, which
keeps a range's size bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bolide.llm.shared import pieces, text_bytes
from bolide.plans.settle import settle

CHUNK_BYTES = 8 << 20
KEY_BITS = 48
OUT = "bucket int, chunk long, keys binary, counts binary"
BACK = "bucket int, chunk long, totals binary, distinct long, sums array<bigint>"


def runs(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches of a task in runs with about ``size`` bytes of ``column`` (one row at least)."""
    kept, total = [], 0
    for batch in batches:
        for part in pieces(batch, column, size):
            n = int(text_bytes(part[column])[1][-1])
            if kept and total + n > size:
                yield pa.concat_batches(kept)
                kept, total = [], 0
            kept.append(part)
            total += n
    if kept:
        yield pa.concat_batches(kept)


def chunked(docs: DataFrame, size: int = CHUNK_BYTES, across: bool = False) -> DataFrame:
    """Write ``docs`` (``text`` and others) as rows: chunk, docs (array of the others), sizes, text.

    A chunk is a part of one Arrow batch or, with ``across``, of all that a task reads.
    """
    others = [c for c in docs.columns if c != "text"]
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "text", size) if across else batches:
            for part in pieces(run, "text", size):
                raw, offsets = text_bytes(part["text"])
                rows = pa.StructArray.from_arrays([part[c] for c in ["_row", *others]], ["_row", *others])
                whole = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part["_row"].slice(0, 1),
                        pa.ListArray.from_arrays(whole, rows),
                        pa.array([zstandard.compress(np.diff(offsets).tobytes(), 1)], pa.binary()),
                        pa.array([zstandard.compress(raw, 1)], pa.binary()),
                    ],
                    ["chunk", "docs", "sizes", "text"],
                )

    fields = [T.StructField("_row", T.LongType()), *[docs.schema[c] for c in others]]
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("docs", T.ArrayType(T.StructType(fields))),
            T.StructField("sizes", T.BinaryType()),
            T.StructField("text", T.BinaryType()),
        ]
    )
    return settle(numbered.mapInArrow(pack, schema), "chunks")


def texts(sizes: bytes, text: bytes) -> pa.Array:
    """The texts of a chunk, in the order of its ``docs``."""
    lengths = np.frombuffer(zstandard.decompress(sizes), np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    raw = zstandard.decompress(text) if offsets[-1] else b""
    return pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
    )


def buckets_for(chunks: int, share: int = 8) -> int:
    """Key ranges, a power of two: one for about ``share`` chunks."""
    return max(16, 1 << (max(1, chunks // share) - 1).bit_length())


def key48(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


def _narrow(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def packed(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int, base: int = 0) -> pa.RecordBatch:
    """A chunk's sorted distinct ``keys`` and their ``counts`` (keys x columns), cut by key range."""
    shift = np.uint64(KEY_BITS - buckets.bit_length() + 1)
    cuts = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << shift)
    full = np.flatnonzero(np.diff(cuts))
    counts = counts.astype("<u4")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(base + full, pa.int32()),
            pa.array(np.full(len(full), chunk), pa.int64()),
            pa.array([_narrow(keys[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
            pa.array(
                [zstandard.compress(counts[cuts[b] : cuts[b + 1]].tobytes(), 1) for b in full], pa.binary()
            ),
        ],
        ["bucket", "chunk", "keys", "counts"],
    )


def tally(out: DataFrame, columns: int) -> DataFrame:
    """Add up ``packed`` rows by key and write each chunk's totals, in the order of its keys."""

    def add(group: pa.Table) -> pa.Table:
        chunks = group["chunk"].to_pylist()
        keys = [_wide(k.as_py()) for k in group["keys"]]
        counts = [
            np.frombuffer(zstandard.decompress(c.as_py()), "<u4").reshape(-1, columns) for c in group["counts"]
        ]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.concatenate(counts)
        totals = np.stack(
            [np.bincount(at, every[:, c], minlength=len(found)) for c in range(columns)], axis=1
        )
        mine = np.split(totals[at].astype("<u8"), np.cumsum([len(k) for k in keys])[:-1])
        sums = totals.sum(0).astype(np.int64).tolist()
        head = [i == 0 for i in range(len(chunks))]
        return pa.Table.from_arrays(
            [
                group["bucket"],
                group["chunk"],
                pa.array([zstandard.compress(m.tobytes(), 1) for m in mine], pa.binary()),
                pa.array([len(found) * h for h in head], pa.int64()),
                pa.array([sums if h else None for h in head], pa.list_(pa.int64())),
            ],
            ["bucket", "chunk", "totals", "distinct", "sums"],
        )

    return settle(out.groupBy("bucket").applyInArrow(add, BACK), "totals")


def totals_of(group: pa.Table, columns: int, base: int, buckets: int) -> np.ndarray:
    """What came back for the keys of one ``packed`` call: keys x columns."""
    rows = sorted(
        (b, t.as_py())
        for b, t in zip(group["bucket"].to_pylist(), group["totals"])
        if b is not None and base <= b < base + buckets
    )
    parts = [np.frombuffer(zstandard.decompress(t), "<u8").reshape(-1, columns) for _, t in rows]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros((0, columns), np.int64)
