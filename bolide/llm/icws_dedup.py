"""Near-dedup by improved consistent weighted sampling over TF-IDF shingles.

* A shingle is five consecutive words (a shorter text is one shingle). Its weight is the
  times it occurs in the document times the sum of its words' inverse document
  frequencies, in whole sixteenths. Document frequencies are counted over all
  documents (``exchange``). Words carry the idf so that a copy's shared shingles weigh
  no less than its changed ones merely because it has copies.
* Each of ``BANDS * ROWS`` consistent weighted samples is drawn over all shingles of the document (Ioffe's
  r, c, beta per shingle and sample), so two documents agree in a sample with the probability of their
  weighted Jaccard similarity, however uneven the weights.
* ``ROWS`` samples make a band; documents that share a band are compared, through
  ``grouping``, by exact weighted Jaccard similarity, and those at or above the
  threshold are one group. Equal texts are one node from the start.

At similarity 0.8 a pair shares none of 24 bands of 5 samples with probability 1e-4.

Defined cases: null and empty texts and texts without words equal each other only if
the texts are equal (null is empty). Null doc_ids come after all others as representative. Repeated
rows belong to the same group. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bolide.llm.exchange import OUT, buckets_for, chunked, key48, packed, tally, texts, totals_of
from bolide.llm.grouping import linked_groups
from bolide.llm.shared import Words, mixed, numbered, pieces
from bolide.plans.settle import apart, settle

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
GRAIN = 16
# Text of a chunk: a task's arrays of words and shingles take some twenty times this.
CHUNK_BYTES = 4 << 20
# Shingles sampled at a time, so that the arrays of a sample stay in the processor's cache.
RUN = 1 << 15
SEEDS = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

def _distinct_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words, sorted, and in how many documents of the chunk each is."""
    found, at = _coded(words)
    # A word of a document as one number, once for each document that has it.
    seen = np.sort(words.doc() * max(1, len(found)) + at)
    seen = seen[np.append(True, seen[1:] != seen[:-1])[: len(seen)]]
    return found, np.bincount(seen % max(1, len(found)), minlength=len(found))


def _coded(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' distinct keys, sorted, and each word's place among them."""
    coded = pa.array(key48(words.hashes())).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[coded.indices.to_numpy()]


def word_frequencies(chunks: DataFrame, buckets: int) -> DataFrame:
    """Each chunk's words' document frequencies over all documents."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = Words(texts(batch["sizes"][i].as_py(), batch["text"][i].as_py()))
                found, n = _distinct_keys(words)
                yield packed(batch["chunk"][i].as_py(), found, n[:, None], buckets)

    return tally(chunks.select("chunk", "sizes", "text").mapInArrow(keys, OUT), 1)


def word_weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequency in whole sixteenths."""
    return np.rint(GRAIN * (1 + np.log((1 + documents) / (1 + frequency)))).astype(np.int64)


def shingles(
    words: Words, weights: np.ndarray, chosen: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, or of those that are ``chosen``: document, hash and weight, sorted by these.

    ``weights`` has the weight of each word of the chunk.
    """
    per, n = words.per_doc, len(words)
    hashes = words.hashes()
    # Words left from here to the document's end say how far a shingle can reach.
    left = np.repeat(words.bounds[1:], per) - np.arange(n)
    whole = np.repeat(per, per)
    begins = (left >= SHINGLE) | ((whole < SHINGLE) & (left == whole))
    if chosen is not None:
        begins &= np.repeat(chosen, per)
    at = np.flatnonzero(begins)
    reach = np.minimum(left[at], SHINGLE)
    h, w = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for size in range(1, SHINGLE + 1):
        on = np.flatnonzero(reach == size)
        if not len(on):
            continue
        begin, sums, total = at[on], np.zeros(len(on), np.uint64), np.zeros(len(on), np.int64)
        for k in range(size):
            sums = mixed(sums + hashes[begin + k] + np.uint64(k + 1))
            total += weights[begin + k]
        h[on], w[on] = sums, total
    doc = words.doc()[at]
    order = _in_order(doc, h, len(per))
    h, w, doc = h[order], w[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.add.reduceat(w, first) if len(first) else w


def _in_order(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Places of the shingles by document, then hash; the order of equal ones is open."""
    bits = np.uint64(max(1, n_docs.bit_length()))
    key = (doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    order = np.argsort(key)
    key, sorted_h = key[order], h[order]
    # Hashes that differ in their last bits only are a rare case.
    if np.any((key[1:] == key[:-1]) & (sorted_h[1:] < sorted_h[:-1])):
        return np.lexsort((h, doc))
    return order


def _gamma_quantiles(bits: int) -> np.ndarray:
    """The middle of each of 2^bits equal shares of Gamma(2, 1): where 1 - (1 + x) e^-x takes their middle values."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.sqrt(2 * p) + p  # near the answer for small shares; the steps below end for all
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x) + 1e-300), x / 4)
    return x


_GAMMA = _gamma_quantiles(16)
_R, _LOG_C = _GAMMA.astype(np.float32), np.log(_GAMMA).astype(np.float32)


def _draw(h: np.ndarray, log_weight: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Ioffe's log a and t of each shingle in one sample; r and c are looked up by 16 bits each."""
    x = h ^ SEEDS[sample]
    x *= np.uint64(0xBF58476D1CE4E5B9)
    y = x >> np.uint64(31)
    x ^= y
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(33), out=y)
    parts = x.view(np.uint16).reshape(-1, 4)
    r = _R.take(parts[:, 1].astype(np.intp))
    beta = parts[:, 3].astype(np.float32)
    beta += np.float32(0.5)
    beta *= np.float32(1 / (1 << 16))
    t = log_weight / r
    t += beta
    np.floor(t, out=t)
    beta -= t
    beta -= np.float32(1)
    beta *= r
    beta += _LOG_C.take(parts[:, 2].astype(np.intp))
    return beta, t


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """``SAMPLES`` samples of each document, each over all of its shingles; zeros without shingles.

    ``doc`` is sorted. Documents are taken in runs of about ``RUN`` shingles.
    """
    out = np.zeros((n_docs, SAMPLES), np.uint64)
    log_weight = np.log(weight).astype(np.float32)
    found, first = np.unique(doc, return_index=True)
    ends = np.append(first[1:], len(doc))
    a = 0
    while a < len(found):
        b = max(a + 1, int(np.searchsorted(ends, first[a] + RUN, "right")))
        lo, hi = first[a], ends[b - 1]
        some, weights, n = h[lo:hi], log_weight[lo:hi], ends[a:b] - first[a:b]
        begin = first[a:b] - lo
        of, steps = np.empty((SAMPLES, b - a), np.uint64), np.empty((SAMPLES, b - a), np.int64)
        for sample in range(SAMPLES):
            log_a, t = _draw(some, weights, sample)
            best = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, begin), n))
            # Of equal ones the first, which has the smallest hash.
            best = best[np.searchsorted(best, begin)]
            of[sample], steps[sample] = some[best], t[best]
        out[found[a:b]] = (mixed(of + mixed(steps.astype(np.uint64))) | np.uint64(1)).T
        a = b
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """Documents x BANDS keys."""
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for band in range(BANDS):
        k = np.full(len(samples), band, np.uint64)
        for row in range(ROWS):
            k = mixed(k + samples[:, band * ROWS + row])
        keys[:, band] = k
    return keys


def _weights_of(words: Words, totals: np.ndarray, documents: int) -> np.ndarray:
    return word_weights(totals[:, 0], documents)[_coded(words)[1]]


def _with_asked(frequencies: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks' totals, and in a row of its own the ids that are ``wanted`` (chunk, id) of each chunk."""
    # No more ids than the chunk has documents.
    asked = wanted.groupBy("chunk").agg(F.collect_list("id").alias("wanted"))
    right = frequencies.select("chunk", "bucket", "totals", F.lit(None).cast("array<bigint>").alias("wanted"))
    return right.unionByName(asked, allowMissingColumns=True)


def _asked_of(right: pa.Table) -> np.ndarray:
    return np.array([i for w in right["wanted"].to_pylist() if w is not None for i in w], np.int64)


def _rows_of(chunk: pa.Table) -> np.ndarray:
    """The numbers of a chunk's documents."""
    return pc.struct_field(chunk["docs"].combine_chunks()[0].values, "_row").to_numpy(zero_copy_only=False)


def _bands(
    chunks: DataFrame, frequencies: DataFrame, wanted: DataFrame, documents: int, buckets: int
) -> DataFrame:
    """(key, id) of the ``wanted`` rows (chunk, id) with words: their bands."""

    def sign(chunk: pa.Table, right: pa.Table) -> pa.Table:
        asked = _asked_of(right)
        if not len(asked) or not chunk.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        words = Words(texts(chunk["sizes"][0].as_py(), chunk["text"][0].as_py()))
        totals = totals_of(right, 1, 0, buckets)
        rows = _rows_of(chunk)
        chosen = np.isin(rows, asked) & (words.per_doc > 0)
        some = np.flatnonzero(chosen)
        doc, h, w = shingles(words, _weights_of(words, totals, documents), chosen)
        keys = band_keys(signatures(doc, h, w, len(rows))[some])
        return pa.table({"key": keys.reshape(-1).view(np.int64), "id": np.repeat(rows[some], BANDS)})

    left = chunks.select("chunk", "docs", "sizes", "text").groupBy("chunk")
    return left.cogroup(_with_asked(frequencies, wanted).groupBy("chunk")).applyInArrow(sign, "key long, id long")


def _vectors(
    chunks: DataFrame, frequencies: DataFrame, wanted: DataFrame, documents: int, buckets: int
) -> DataFrame:
    """Write the shingles and weights of the ``wanted`` rows (chunk, id)."""

    def describe(chunk: pa.Table, right: pa.Table) -> pa.Table:
        asked = _asked_of(right)
        ids, blobs = [], []
        if len(asked) and chunk.num_rows:
            rows = _rows_of(chunk)
            chosen = np.isin(rows, asked)
            words = Words(texts(chunk["sizes"][0].as_py(), chunk["text"][0].as_py()))
            totals = totals_of(right, 1, 0, buckets)
            doc, h, w = shingles(words, _weights_of(words, totals, documents), chosen)
            ends = np.searchsorted(doc, np.arange(len(rows) + 1))
            for i in np.flatnonzero(chosen):
                a, b = ends[i], ends[i + 1]
                ids.append(rows[i])
                blobs.append(vector(h[a:b], w[a:b]))
        return pa.table({"id": pa.array(ids, pa.int64()), "vector": pa.array(blobs, pa.binary())})

    right = _with_asked(frequencies, wanted).groupBy("chunk")
    left = chunks.select("chunk", "docs", "sizes", "text").groupBy("chunk")
    return settle(left.cogroup(right).applyInArrow(describe, "id long, vector binary"), "vectors")


def vector(h: np.ndarray, w: np.ndarray) -> bytes:
    """Sorted hashes, then weights."""
    return h.astype("<u8").tobytes() + w.astype("<u4").tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two vectors."""
    (ha, wa), (hb, wb) = map(_opened, (a, b))
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[at] == ha
    least = np.minimum(wa[same], wb[at[same]]).sum()
    return float(least / (wa.sum() + wb.sum() - least))


def _opened(v: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(v) // 12
    return np.frombuffer(v, "<u8", n), np.frombuffer(v, "<u4", n, 8 * n).astype(np.int64)


def verified(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact weighted similarity is at least ``least``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similarity(x.as_buffer(), y.as_buffer()) >= least
                for x, y in zip(batch["vector_a"], batch["vector_b"])
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = vectors.select(F.col("id").alias("a"), F.col("vector").alias("vector_a"))
    two = vectors.select(F.col("id").alias("b"), F.col("vector").alias("vector_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(compare, "a long, b long")


def shared_weights(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Of each id the total weight, and the weight of shingles that another of ``ids`` has too."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "vector"):
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"].slice(0, 1),
                        pa.array([part["id"].to_pylist()], pa.list_(pa.int64())),
                        pa.array([part["vector"].to_pylist()], pa.list_(pa.binary())),
                    ],
                    ["chunk", "ids", "vectors"],
                )

    rows = vectors.join(ids, "id", "left_semi").select("id", "vector")
    rows = settle(rows.mapInArrow(gather, "chunk long, ids array<bigint>, vectors array<binary>"), "gathered")
    buckets = buckets_for(rows.count())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blobs in zip(batch["chunk"].to_pylist(), batch["vectors"].to_pylist()):
                every = np.concatenate([_opened(b)[0] for b in blobs])
                found, n = np.unique(key48(every), return_counts=True)
                yield packed(chunk, found, n[:, None], buckets)

    def weigh(chunk: pa.Table, back: pa.Table) -> pa.Table:
        opened = [_opened(b) for b in chunk["vectors"][0].as_py()]
        k, w = key48(np.concatenate([o[0] for o in opened])), np.concatenate([o[1] for o in opened])
        _, at = np.unique(k, return_inverse=True)
        w2 = w * (totals_of(back, 1, 0, buckets)[at, 0] > 1)
        cuts = np.cumsum([0, *[len(o[0]) for o in opened]])[:-1]
        return pa.table(
            {
                "id": chunk["ids"][0].values,
                "total": np.add.reduceat(w, cuts).astype(np.float64),
                "shared": np.add.reduceat(w2, cuts).astype(np.float64),
            }
        )

    back = tally(rows.select("chunk", "vectors").mapInArrow(keys, OUT), 1)
    right = back.select("chunk", "bucket", "totals").groupBy("chunk")
    found = rows.groupBy("chunk").cogroup(right).applyInArrow(weigh, "id long, total double, shared double")
    return settle(found, "weights")


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One written row per row of ``docs`` (doc_id, text and others): ``_row``, the others and ``head``.

    ``head`` is a struct of the row that stands for the class (null doc_ids last).
    """
    return apart("near", lambda: _near_classes(docs, least))


def _near_classes(docs: DataFrame, least: float) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    chunks = chunked(docs.select("doc_id", *others, text.alias("text"), F.sha2(text, 256).alias("digest")), CHUNK_BYTES)
    rows = settle(chunks.select("chunk", F.explode("docs").alias("d")).select("chunk", "d.*"), "rows")
    documents, n_chunks = rows.count(), chunks.count()
    buckets = buckets_for(n_chunks)
    frequencies = word_frequencies(chunks, buckets)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_row", "chunk")
    # Equal texts: the first row stands for all.
    nodes = settle(rows.groupBy("digest").agg(F.min(place).alias("first")), "nodes")
    stands = nodes.select("first.chunk", F.col("first._row").alias("id"))
    bands = settle(_bands(chunks, frequencies, stands, documents, buckets), "bands")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = settle(bands.join(shared, "key", "left_semi"), "shared")
    wanted = members.select("id").distinct().join(rows.select(F.col("_row").alias("id"), "chunk"), "id")
    vectors = _vectors(chunks, frequencies, wanted, documents, buckets)
    labels = linked_groups(
        members,
        lambda pairs: verified(pairs, vectors, least),
        lambda ids: shared_weights(ids, vectors),
        least,
    )
    named = nodes.join(labels, F.col("first._row") == F.col("node"), "left").select(
        "digest", "first", F.coalesce("label", "first._row").alias("label")
    )
    named = settle(named, "named")
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    classes = named.join(heads, "label").select("digest", "head")
    return rows.join(classes, "digest").select("_row", *[c for c in rows.columns if c in ("doc_id", *others)], "head")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every document."""
    return near_classes(docs.select("doc_id", "text"), least).select(
        "doc_id", F.col("head.doc_id").alias("class_id"), (F.col("head._row") == F.col("_row")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (all columns), one of each class."""
    rows = numbered(docs, "near")
    named = rows.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"), F.col("_row").alias("number"))
    classes = near_classes(named, least)
    gone = classes.filter("head._row <> _row").select(F.col("number").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select("_doc.*")
