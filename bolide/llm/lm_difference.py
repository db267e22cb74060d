"""Cross-entropy difference of two matched bigram models (Moore-Lewis scoring).

The target model is counted over the documents labelled good, the background model over all
documents; a labelled document is scored by the target model of the other labelled rows, so that
it doesn't speak for itself. Both are bigram models interpolated with smoothed unigrams over one shared
vocabulary: every distinct word of any document, and the end of a text. A token's difference is
its loss under the target model less its loss under the background model, and a
document's score the mean of its tokens' differences: the lower, the more like the target.

All words and bigrams are counted: a run of documents (``RUN_BYTES`` of text) sends its distinct keys to
``exchange`` and gets the counts of both models back, so no table of counts is held by any one task
or the driver, and the work grows with the corpus.

Defined cases: a null or empty text is one token, the end. Without target documents the target
model is uniform. Rows that repeat are counted and scored each. Labels of
null or unknown ids are passed over; an id labelled twice is a target if either says so.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bolide.llm.exchange import OUT, buckets_for, chunked, key48, packed, tally, texts, totals_of
from bolide.llm.shared import Words, mixed, pieces
from bolide.plans.settle import settle

# Weight of the bigram estimate, and what is added to each unigram count.
BIGRAM, ADDED = 0.6, 0.1
# Text of a run, which sends each of its keys once, and of the part whose words are in memory at a time.
RUN_BYTES, PIECE_BYTES = 16 << 20, 4 << 20
# So many ids of target documents, 16 MB, are broadcast; beyond, texts and ids are shuffled.
TARGET_IDS = 2_000_000
BEGIN, END = np.uint64(0x1F3A), np.uint64(0x2B7C)
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys with a begin before and an end after each text; those before each token; document."""
    words = Words(column)
    per = words.per_doc + 2
    first = np.concatenate([[0], np.cumsum(per)])
    every = np.empty(int(first[-1]), np.uint64)
    inside = np.ones(len(every), bool)
    inside[first[:-1]] = inside[first[1:] - 1] = False
    every[inside] = words.hashes()
    every[first[:-1]], every[first[1:] - 1] = mixed(BEGIN[None]), mixed(END[None])
    doc = np.repeat(np.arange(len(per)), per)
    follows = np.ones(len(every), bool)
    follows[first[:-1]] = False
    at = np.flatnonzero(follows)
    return every, at, doc


def pair_keys(every: np.ndarray, at: np.ndarray) -> np.ndarray:
    return key48(mixed(every[at - 1] + mixed(every[at] + np.uint64(1))))


def _counted(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs in all and in target tokens."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(at, minlength=len(found)), np.bincount(at, target, len(found))], axis=1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several parts and their counts added up."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")  # runs in order already: merged, not sorted
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(n[order], at, axis=0) if len(at) else n


def parts_of(sizes: bytes, text: bytes, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """The texts of a run, a few megabytes at a time, with the places of the first and after the last."""
    column = texts(sizes, text)
    first = 0
    for part in pieces(pa.RecordBatch.from_arrays([column], ["text"]), "text", size):
        yield first, first + part.num_rows, part["text"]
        first += part.num_rows


def counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """Totals of words (ranges below ``buckets``) and bigrams (the rest) for every run."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch["chunk"][i].as_py()
                marked = np.array([d["target"] for d in batch["docs"][i].as_py()], bool)
                words, pairs = [], []
                for a, b, column in parts_of(batch["sizes"][i].as_py(), batch["text"][i].as_py()):
                    every, at, doc = tokens(column)
                    target = marked[a:b][doc]
                    words.append(_counted(key48(every), target))
                    pairs.append(_counted(pair_keys(every, at), target[at]))
                yield packed(chunk, *_merged(words), buckets)
                yield packed(chunk, *_merged(pairs), buckets, base=buckets)

    return tally(chunks.mapInArrow(keys, OUT), 2)


def repeats(doc: np.ndarray, of_key: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Per token how often its document has its key, 0 outside ``where``."""
    out = np.zeros(len(doc), np.int64)
    at = np.flatnonzero(where)
    if len(at):
        pair = doc[at].astype(np.int64) * (int(of_key.max()) + 1) + of_key[at]
        _, same, n = np.unique(pair, return_inverse=True, return_counts=True)
        out[at] = n[same]
    return out


def losses(
    word: np.ndarray, before: np.ndarray, pair: np.ndarray, total: np.ndarray | float, vocabulary: int
) -> np.ndarray:
    """-ln P of tokens from the counts of the word, of the word before, and of both in a row."""
    unigram = (word + ADDED) / (total + ADDED * vocabulary)
    # Where the word before is unknown to the model, the unigram has all the weight.
    share = np.where(before > 0, BIGRAM, 0)
    return -np.log(share * pair / np.maximum(before, 1) + (1 - share) * unigram)


def marked(docs: DataFrame, targets: DataFrame, most: int = TARGET_IDS) -> DataFrame:
    """``doc_id``, ``text`` and whether the document is a target; up to ``most`` ids go to the texts, not they to the ids."""
    ids = settle(
        targets.filter(F.col("doc_id").isNotNull()).select("doc_id", F.lit(True).alias("target")).distinct(),
        "targets",
    )
    few = ids.count() <= most
    found = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left")
    return found.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def scores(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Scores of ``docs`` (doc_id, text) for the target documents' ids ``targets`` (doc_id)."""
    chunks = chunked(marked(docs, targets), RUN_BYTES, across=True)
    buckets = buckets_for(chunks.count(), 2)
    back = counts(chunks, buckets)
    words = back.filter(F.col("bucket") < buckets)
    # Scalars: distinct words and the tokens of either model; begins are not tokens.
    vocabulary, everything, target = words.agg(
        F.sum("distinct"), F.sum(F.col("sums")[0]), F.sum(F.col("sums")[1])
    ).first()
    begins = chunks.select(F.explode("docs").alias("d")).agg(
        F.count(F.lit(1)), F.sum(F.col("d.target").cast("long"))
    ).first()
    vocabulary = max(1, (vocabulary or 0) - 1)
    everything, target = (everything or 0) - begins[0], (target or 0) - (begins[1] or 0)

    def score(chunk: pa.Table, back: pa.Table) -> pa.Table:
        rows = chunk["docs"][0].as_py()
        marked = np.array([r["target"] for r in rows], bool)
        parts, word_keys, pair_keys_ = [], [], []
        for a, b, column in parts_of(chunk["sizes"][0].as_py(), chunk["text"][0].as_py()):
            every, at, doc = tokens(column)
            words, of_word = np.unique(key48(every), return_inverse=True)
            pairs, of_pair = np.unique(pair_keys(every, at), return_inverse=True)
            word_keys.append(words)
            pair_keys_.append(pairs)
            small = (x.astype(np.int32) for x in (at, doc, of_word, of_pair))
            parts.append((*small, marked[a:b]))
        all_words, all_pairs = np.unique(np.concatenate(word_keys)), np.unique(np.concatenate(pair_keys_))
        word_totals, pair_totals = totals_of(back, 2, 0, buckets), totals_of(back, 2, buckets, buckets)
        if len(word_totals) != len(all_words) or len(pair_totals) != len(all_pairs):
            raise ValueError("a run's counts did not all come back")
        sizes, means = [], ([], [])
        for (at, doc, of_word, of_pair, own), words, pairs in zip(parts, word_keys, pair_keys_):
            word = word_totals[np.searchsorted(all_words, words)][of_word]
            pair = pair_totals[np.searchsorted(all_pairs, pairs)][of_pair]
            n = np.bincount(doc[at])
            sizes.append(n)
            # The target model of a target document is that of the others.
            word[:, 1] -= repeats(doc, of_word, own[doc])
            pair[:, 1] -= repeats(doc[at], of_pair, own[doc[at]])
            for mean, column, total in zip(means, (1, 0), ((target - n * own)[doc[at]], everything)):
                loss = losses(word[at, column], word[at - 1, column], pair[:, column], total, vocabulary)
                mean.append(np.bincount(doc[at], loss) / n)
        of_target, of_all = np.concatenate(means[0]), np.concatenate(means[1])
        return pa.table(
            {
                "doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()),
                "n_tokens": np.concatenate(sizes),
                "target_loss": of_target,
                "background_loss": of_all,
                "score": of_target - of_all,
            }
        )

    left = chunks.groupBy("chunk")
    right = back.select("chunk", "bucket", "totals").groupBy("chunk")
    return left.cogroup(right).applyInArrow(score, SCORES)
