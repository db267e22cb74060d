"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of them. Each passage is encoded by
numbers about its bytes and words; labels are known for whole documents only.
A gated attention network (tanh gate times sigmoid gate) learns how much each passage
counts, and a logistic unit scores the weighted passage representation. The
network is fitted on a bounded sample (``TRAIN_ROWS``, ``TRAIN_BYTES``) and sent to the
tasks; a document is scored where it is read, with no shuffle.

Defined cases: a null or empty text is a bag of one empty passage. Without labelled rows of
both kinds every score is the share of label 1 among them (0.5 without any). Empty
tables give no rows. Repeated doc_ids are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bolide.llm.shared import Words, held_out, labelled_sample, mixed, pieces, send

PASSAGE = 128
TRAIN_ROWS = 8_000
TRAIN_BYTES = 48 << 20
HIDDEN = 16
ATTENTION = 8
EPOCHS = 12
THRESHOLD = 0.3
# Text encoded at a time: a task's arrays of bytes, pairs and passages take some thirty times this.
PIECE_BYTES = 1 << 20

_KINDS = 10


def _byte_kinds() -> np.ndarray:
    """Lower, upper, digit, space, line end, stop, shout, bracket or quote, symbol, non-ASCII."""
    kind = np.full(256, 8, np.int64)
    groups = {4: "\t\n\r\f\v", 3: " ", 5: ".,;:", 6: "!?", 7: "\"'()[]{}-"}
    for k, chars in groups.items():
        for c in chars:
            kind[ord(c)] = k
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[0x80:] = 9
    return kind


KIND = _byte_kinds()
FEATURES = _KINDS * _KINDS + 6


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and each document's first passage."""
    words = Words(column)
    n_docs = len(words.per_doc)
    per_doc = np.maximum(1, -(-words.per_doc // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    n = int(first[-1])
    # Bytes belong to the passage whose first word they follow; a document's head to its first.
    within = np.arange(n) - np.repeat(first[:-1], per_doc)
    lead = np.repeat(words.bounds[:-1], per_doc) + within * PASSAGE
    begin = np.repeat(words.offsets[:-1], per_doc)
    later = within > 0
    begin[later] = words.start[lead[later]]
    stop = np.concatenate([begin[1:], [len(words.raw)]])
    size = (stop - begin).astype(np.float64)
    kind = KIND[words.raw]
    pair = kind[:-1] * _KINDS + kind[1:] if len(kind) > 1 else kind[:0]
    of_byte = np.repeat(np.arange(n), stop - begin)
    key = of_byte[: len(pair)] * (_KINDS * _KINDS) + pair
    pairs = np.bincount(key, minlength=n * _KINDS * _KINDS).reshape(n, -1)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, : _KINDS * _KINDS] = np.sqrt(pairs / np.maximum(size, 1)[:, None])
    # The words of a passage: how many, how long, how varied, how often twice running.
    of_word = np.repeat(np.arange(n), _words_in(words.per_doc, per_doc, within))
    count = np.bincount(of_word, minlength=n)
    some = np.maximum(count, 1)
    hashes, length = words.hashes(), words.end - words.start
    # Equal words of a passage have equal keys.
    key = mixed(of_word.astype(np.uint64)) ^ hashes
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    distinct = np.bincount(of_word[order[new]], minlength=n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    mean = np.bincount(of_word, length, minlength=n) / some
    square = np.bincount(of_word, length.astype(np.float64) ** 2, minlength=n) / some
    extra = [
        np.log1p(count),
        np.log1p(size),
        distinct / some,
        np.bincount(of_word, again, minlength=n) / some,
        mean,
        np.sqrt(np.maximum(square - mean**2, 0)),
    ]
    out[:, _KINDS * _KINDS :] = np.stack(extra, axis=1)
    return out, first


def _words_in(words: np.ndarray, passages: np.ndarray, within: np.ndarray) -> np.ndarray:
    left = np.repeat(words, passages) - within * PASSAGE
    return np.clip(left, 0, PASSAGE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of the network, and the scale of its inputs; ``constant`` where there is nothing to fit."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, per = self.weights, np.diff(first)
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ w["in"] + w["in0"])
        t, s = np.tanh(h @ w["gate_t"]), _sigmoid(h @ w["gate_s"])
        a = (t * s) @ w["gate"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first[:-1]), per))
        a /= np.repeat(np.add.reduceat(a, first[:-1]), per)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        p = _sigmoid(z @ w["out"] + w["out0"])
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": p}

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None or not len(column):
            return np.full(len(column), self.constant or 0.0)
        return self.forward(*encode(column))["p"].astype(np.float64)

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f, per = self.weights, self.forward(x, first), np.diff(first)
        d = (f["p"] - y) / len(y)
        dz = np.repeat(d[:, None] * w["out"], per, axis=0)
        da = (dz * f["h"]).sum(1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), per))
        dt = da[:, None] * w["gate"] * f["s"] * (1 - f["t"] ** 2)
        ds = da[:, None] * w["gate"] * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz + dt @ w["gate_t"].T + ds @ w["gate_s"].T
        dh *= 1 - f["h"] ** 2
        return {
            "in": f["x"].T @ dh,
            "in0": dh.sum(0),
            "gate_t": f["h"].T @ dt,
            "gate_s": f["h"].T @ ds,
            "gate": (f["t"] * f["s"]).T @ da,
            "out": f["z"].T @ d,
            "out0": d.sum(keepdims=True),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam over batches of documents, with a small weight decay."""
    kinds = set(labels.tolist())
    if len(kinds) < 2:
        return Model({}, np.zeros(1), np.ones(1), float(labels.mean()) if len(labels) else 0.5)
    every = np.concatenate(bags)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    weights = {
        "in": draw(FEATURES, HIDDEN),
        "in0": np.zeros(HIDDEN),
        "gate_t": draw(HIDDEN, ATTENTION),
        "gate_s": draw(HIDDEN, ATTENTION),
        "gate": draw(ATTENTION),
        "out": draw(HIDDEN),
        "out0": np.log([labels.mean() / (1 - labels.mean())]),
    }
    model = Model(weights, every.mean(0), np.maximum(every.std(0), 0.02))
    m = {k: np.zeros_like(v) for k, v in weights.items()}
    v = {k: np.zeros_like(x) for k, x in weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS)
            for k, g in model.gradient(np.concatenate([bags[i] for i in some]), first, labels[some]).items():
                g = g + 1e-4 * weights[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """Encode the bounded sample on the executors, fit on the driver."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                x, first = encode(part["text"])
                blobs = [x[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part["turn"], part["label"], pa.array(blobs, pa.binary())], ["turn", "label", "bag"]
                )

    sample = labelled_sample(docs, labels, "quality", rows, size)
    found = sample.mapInArrow(bags, "turn long, label int, bag binary").collect()
    found.sort(key=lambda r: (r["turn"], r["label"], bytes(r["bag"])))
    return fit(
        [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in found],
        np.array([r["label"] for r in found], np.float64),
    )


def scored(docs: DataFrame, model: Model, out: str = "score", within: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``out``, row by row where they are read.

    The text is the column ``text``, or the field of that name of the struct ``within``.
    """
    load = send(docs.sparkSession, model)
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = load()
        for batch in batches:
            text = batch["text"] if within is None else pc.struct_field(batch[within], "text")
            # The text beside the columns, whatever their names, so that both are cut alike.
            for part in pieces(pa.RecordBatch.from_arrays([text, *batch.columns], ["", *names]), "", PIECE_BYTES):
                scores = pa.array(fitted.score(part.column(0)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], scores], [*names, out])

    return docs.mapInArrow(score, T.StructType([*docs.schema, T.StructField(out, T.DoubleType())]))


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = scored(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) that the classifier doesn't reject."""
    packed = docs.select(F.struct("*").alias("_doc"))
    rows = scored(packed, train(docs, labels), "_score", "_doc")
    return rows.filter(F.col("_score") >= threshold).select("_doc.*")
