"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: a row holds, for a run of documents, the
postings (document, position) of each term, sorted. Positions of a run are
numbers ``document * 2^32 + MARGIN + position``, so a posting list is one sorted array. Terms
are told apart by their letters; those that no test item has are left out, as no list of theirs
is ever read.

A query is a window of test words, looked up only where its rarest term occurs. Its terms are taken from the rarest to the
most frequent (counts over all documents): the rarest list, shifted by the term's
offset, gives the places where the window may start, and each further list keeps those
that it has too. With ``slop`` a term may be up to so many words away from its
place: that gives the proximity matches, the exact ones among them.

Test items are taken in blocks of about ``BLOCK_WORDS`` words, so that the terms and
windows sent to every task stay bounded however large the test set is.

Defined cases: null or empty texts have no words and no hits; a null item_id counts as the
empty name; repeated doc_ids get a row each, repeated items count once per name. Empty
tables: no documents, no rows; no items, no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bolide.llm.shared import Words, numbered, pieces
from bolide.plans.settle import apart, settle

WINDOW = 10
SLOP = 2
BLOCK_WORDS = 1_000_000
# Text of a run of documents.
RUN_BYTES = 8 << 20
# A window that begins before its document does still has a number of that document.
MARGIN = 1 << 24

INDEX = (
    "rows array<bigint>, doc_ids array<bigint>, n_words array<int>, "
    "terms array<int>, counts array<bigint>, postings binary"
)
FOUND = (
    "_row long, doc_id long, n_words long, items array<string>, near_items array<string>, "
    "spans array<struct<first: int, last: int>>"
)


@dataclass
class Queries:
    """One block of windows: term numbers, and per window its item, terms and offsets."""

    vocabulary: pa.Array  # the words
    items: list[str]
    windows: list[tuple[int, np.ndarray]]  # item number, term number at each offset


def windows_of(benchmark: DataFrame, width: int = WINDOW) -> list[Queries]:
    """Test items in blocks; each item's windows of ``width`` words, or one if it is shorter."""
    words = F.greatest(F.length("text") / 2, F.lit(1))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    out = []
    for b in range(blocks):
        of = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = of.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct().collect()
        spoken = Words(pa.array([r["text"] for r in rows], pa.string()))
        coded, bounds = spoken.spelled().dictionary_encode(), spoken.bounds
        vocabulary, numbers = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        windows = []
        for i in range(len(rows)):
            own = numbers[bounds[i] : bounds[i + 1]]
            for at in range(max(len(own) - width + 1, min(len(own), 1))):
                windows.append((i, own[at : at + width]))
        out.append(Queries(vocabulary, [r["item_id"] or "" for r in rows], windows))
    return out


def build_index(rows: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Write the postings of the ``vocabulary`` in ``rows`` (_row, doc_id, text)."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in (p for b in batches for p in pieces(b, "text", RUN_BYTES)):
            words = Words(batch["text"])
            term = pc.index_in(words.spelled(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            of_test = term >= 0
            place = np.arange(len(words)) - np.repeat(words.bounds[:-1], words.per_doc) + MARGIN
            posting = (words.doc()[of_test] << 32) | place[of_test]
            term = term[of_test]
            order = np.argsort(term, kind="stable")  # documents and positions are in order already
            terms, counts = np.unique(term, return_counts=True)
            # Differences inside the run are small numbers, which pack well.
            steps = np.diff(posting[order], prepend=0).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch["_row"].to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch["doc_id"].cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
                    pa.array([words.per_doc], pa.list_(pa.int32())),
                    pa.array([terms], pa.list_(pa.int32())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([zstandard.compress(steps.tobytes(), 1)], pa.binary()),
                ],
                ["rows", "doc_ids", "n_words", "terms", "counts", "postings"],
            )

    return settle(rows.select("_row", "doc_id", "text").mapInArrow(index, INDEX), "postings")


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each term over all documents; one row per test term comes to the driver."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    sums = pairs.groupBy("p.terms").agg(F.sum("p.counts").alias("n")).collect()
    out = np.zeros(n_terms, np.int64)
    for r in sums:
        out[r["terms"]] = r["n"]
    return out


def intersect(lists: dict[int, np.ndarray], terms: np.ndarray, order: np.ndarray, slop: int):
    """Starts of a window: those within ``slop``, and which of them are exact."""
    offsets = order  # the offset of a term is its place in the window
    anchor = lists.get(int(terms[order[0]]))
    if anchor is None:
        return None
    start = anchor - order[0]
    start = start[(start & 0xFFFFFFFF) >= MARGIN - slop]
    exact = (start & 0xFFFFFFFF) >= MARGIN
    for off in offsets[1:]:
        listed = lists.get(int(terms[off]))
        if listed is None or not len(start):
            return None
        want = start + off
        at = np.searchsorted(listed, want - slop)
        found = at < len(listed)
        found &= listed[np.minimum(at, len(listed) - 1)] <= want + slop
        if slop:
            here = np.minimum(np.searchsorted(listed, want), len(listed) - 1)
            exact &= listed[here] == want
        start, exact = start[found], exact[found]
    return (start, exact) if len(start) else None


def search(index: DataFrame, queries: Queries, counts: np.ndarray, slop: int = SLOP) -> DataFrame:
    """Per document: items with an exact and with a proximity match, and the words in exact ones."""
    # Rarest first; windows that are equal up to their item are looked up once.
    shared: dict[tuple, list[int]] = {}
    for item, terms in queries.windows:
        shared.setdefault(tuple(terms.tolist()), []).append(item)
    plan: dict[int, list[tuple]] = {}
    for t, of in shared.items():
        order = np.argsort(counts[list(t)], kind="stable")
        plan.setdefault(t[order[0]], []).append((np.array(t, np.int64), order, sorted(set(of))))
    sent = index.sparkSession.sparkContext.broadcast((plan, queries.items))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, names = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                yield _searched(batch, i, plan, names, slop)

    return index.mapInArrow(look_up, FOUND)


def _searched(batch, i: int, plan, names: list[str], slop: int) -> pa.RecordBatch:
    rows, doc_ids, n_words = (batch[c][i].as_py() for c in ("rows", "doc_ids", "n_words"))
    terms, counts = batch["terms"][i].as_py(), batch["counts"][i].as_py()
    steps = np.frombuffer(zstandard.decompress(batch["postings"][i].as_py()), "<i8")
    lists = dict(zip(terms, np.split(np.cumsum(steps), np.cumsum(counts)[:-1]))) if terms else {}
    items: list[set[str]] = [set() for _ in rows]
    near: list[set[str]] = [set() for _ in rows]
    spans: list[list[tuple[int, int]]] = [[] for _ in rows]
    for window, order, of in chain.from_iterable(plan[t] for t in terms if t in plan):
        found = intersect(lists, window, order, slop)
        if found is None:
            continue
        start, exact = found
        for d in np.unique(start >> 32):
            near[d].update(names[k] for k in of)
        for s in start[exact]:
            d, first = int(s) >> 32, (int(s) & 0xFFFFFFFF) - MARGIN
            items[d].update(names[k] for k in of)
            spans[d].append((first, first + len(window)))
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rows, pa.int64()),
            pa.array(doc_ids, pa.int64()),
            pa.array(n_words, pa.int64()),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            pa.array([sorted(x) for x in near], pa.list_(pa.string())),
            pa.array([[{"first": a, "last": b} for a, b in merged(x)] for x in spans], span),
        ],
        ["_row", "doc_id", "n_words", "items", "near_items", "spans"],
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as a sorted list without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(rows: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """``search`` of ``rows`` (_row, doc_id, text) for all items, block after block."""
    parts = []
    for queries in windows_of(benchmark, width):
        index = build_index(rows, queries.vocabulary)
        parts.append(search(index, queries, term_counts(index, len(queries.vocabulary)), slop))
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        # As many rows per document as there are blocks.
        found = found.groupBy("_row").agg(
            F.any_value("doc_id").alias("doc_id"),
            F.any_value("n_words").alias("n_words"),
            *[F.flatten(F.collect_list(c)).alias(c) for c in ("items", "near_items", "spans")],
        )
    return found


def hit_words(spans: str = "spans"):
    """Words inside any of the spans, which may overlap."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["last"]).alias("end"),
        (acc["n"] + F.greatest(s["last"] - F.greatest(s["first"], acc["end"]), F.lit(0))).alias("n"),
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per document: words, words hit, items found, and whether it is contaminated."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    return digest(matches(rows, benchmark, width, slop)).drop("_row")


def digest(found: DataFrame) -> DataFrame:
    items = F.array_sort(F.array_distinct("items"))
    near = F.array_except("near_items", "items")
    return found.select(
        "_row",
        "doc_id",
        "n_words",
        hit_words().cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size(near).cast("long").alias("n_near_items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no test window occurs."""
    rows = numbered(docs, "decontaminate")
    named = rows.select("_row", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))
    bad = apart("found", lambda: matches(named, benchmark, width, 0).filter(F.size("spans") > 0).select("_row"))
    return rows.join(bad, "_row", "left_anti").select("_doc.*")
