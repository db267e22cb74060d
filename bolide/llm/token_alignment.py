"""Alignment of the tokens that two tokenizers make of the same texts.

A is a byte-level BPE over space + text, B a piece model that adds the space itself. Where both
make exactly those bytes, offsets at which a token of each ends cut the tokens into *groups*; the
pairs of an A and a B token of one group are its *links*.

1. Words (a space and what follows, up to the next space after a visible character) are encoded
   once per run of documents and remembered by their text; neither tokenizer joins tokens over such a
   space. A word is checked against its tokens' bytes when it is first met.
2. All documents of a run are merged in lockstep: one vector holds, for every document (long ones in
   stretches of ``STRETCH`` A tokens), where it stands in A and in B. A step links the two
   tokens, advances whichever ends first, marks a cut where both end, and drops finished rows.
3. A run (*chunk*) sends each of its id pairs once, with the number of its documents that hold it;
   the sums over all chunks, and the highest sum of each A id, come back to the chunks by pair.
   Every number that is shuffled has a fixed width, and no list of all pairs goes anywhere.

Groups of several tokens on both sides are linked by distinct ids and their numbers, so a long
stretch without common cuts doesn't form its links one by one.

Defined cases: null and empty texts, and texts whose bytes a tokenizer changes, have no tokens:
zeros and ''. Repeated doc_ids get a row each and count as documents of their own. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bolide.llm.shared import pieces, text_bytes
from bolide.plans.settle import settle

# Text of a chunk, in bytes: bounds a task's memory.
CHUNK_BYTES = 4 << 20
# A tokens that one row of the state vector goes through.
STRETCH = 256
# Words a worker process remembers.
REMEMBERED = 400_000
# Links of wide groups formed at a time.
WIDE = 1 << 20

CHUNKS = (
    "doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
    "n_links array<bigint>, hashes array<string>, keys binary, docs binary, sizes binary, at binary, times binary"
)
REPORT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)
_PLAIN = ["n_a", "n_b", "n_groups", "n_links"]


def byte_of_letter() -> dict[str, int]:
    """The rule by which byte-level vocabularies spell bytes: visible Latin-1 as itself, the rest from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers over words, remembering what they gave for a word."""

    def __init__(self, a_path: str, b_path: str):
        # Tasks run side by side already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_of_letter()
        a_names = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
        self.a_bytes = [bytes(letters[c] for c in t) if set(t) <= set(letters) else t.encode() for t in a_names]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(b.id_to_piece(list(range(b.get_piece_size()))))
        ]
        self.a_size, self.b_size = (np.array([len(t) for t in s], np.int64) for s in (self.a_bytes, self.b_bytes))
        self.a, self.b = a, b
        self.space = [b.piece_to_id("▁")]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.count = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.pool = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.same = np.zeros(0, bool)

    def _learn(self, words: list[str]) -> None:
        got_a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        # B adds the space that a word begins with; of a lone space nothing else is left.
        got_b = self.b.encode([w[1:] for w in words], num_threads=1)
        got_b = [g if w != " " else self.space for g, w in zip(got_b, words)]
        same = []
        for word, a, b in zip(words, got_a, got_b):
            raw = word.encode()
            same.append(
                b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
            )
        self.same = np.concatenate([self.same, same])
        for side, got in enumerate((got_a, got_b)):
            count = np.array([len(g) for g in got], np.int64)
            self.first[side] = np.concatenate([self.first[side], len(self.pool[side]) + np.cumsum(count) - count])
            self.count[side] = np.concatenate([self.count[side], count])
            flat = np.fromiter((i for g in got for i in g), np.int32, int(count.sum()))
            self.pool[side] = np.concatenate([self.pool[side], flat])
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words))))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The place of each of the distinct ``words`` among the known ones."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = words
        if fresh:
            self._learn(fresh)
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))

    def ids(self, side: int, words: np.ndarray) -> np.ndarray:
        """Ids of words in a row."""
        count = self.count[side][words]
        before = np.cumsum(count) - count
        return self.pool[side][np.repeat(self.first[side][words] - before, count) + np.arange(count.sum())]


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """The worker process's tokenizers: later tasks of the process find the words of earlier ones."""
    import tokenizers

    held = vars(tokenizers).setdefault("_corpus_pairs", {})
    if (a_path, b_path) not in held:
        held[a_path, b_path] = Tokenizers(a_path, b_path)
    return held[a_path, b_path]


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin in texts that begin with a space: there, and at spaces after a visible character."""
    visible = (raw > 0x20) & (raw != 0x7F)
    # White space beyond ASCII, by its first bytes, and the sign that B takes for a space.
    for lead, following, width in (
        (0xC2, (0x85, 0xA0), 2),
        (0xE1, (0x9A,), 3),
        (0xE2, (0x80, 0x81, 0x96), 3),
        (0xE3, (0x80,), 3),
    ):
        at = np.flatnonzero(raw[:-1] == lead)
        at = at[np.isin(raw[at + 1], following)] + width - 1
        visible[at[at < len(raw)]] = False
    begins = np.zeros(len(raw), bool)
    begins[1:] = (raw[1:] == 0x20) & visible[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


def lockstep(
    a_end: np.ndarray, b_end: np.ndarray, starts: np.ndarray, stops: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge rows of tokens side by side: overlapping pairs (a, b), and which tokens end at a cut.

    Row k goes through A tokens ``starts[k]`` to ``stops[k]``. ``a_end`` and ``b_end`` are byte offsets.
    """
    cut_a, cut_b = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    a = starts.astype(np.int64)
    begin = np.where(a > 0, a_end[a - 1], 0)
    b, stop = np.searchsorted(b_end, begin, "right"), stops
    linked_a, linked_b = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    while len(a):
        linked_a.append(a.astype(np.int32))
        linked_b.append(b.astype(np.int32))
        of_a, of_b = a_end[a], b_end[b]
        both = of_a == of_b
        cut_a[a[both]] = True
        cut_b[b[both]] = True
        a, b = a + (of_a <= of_b), b + (of_b <= of_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return np.concatenate(linked_a), np.concatenate(linked_b), cut_a, cut_b


def _stretches(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the state vector: each document's A tokens in stretches."""
    last = np.cumsum(counts)
    n = -(-counts // size)
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(last - counts, n) + row * size
    return starts, np.minimum(starts + size, np.repeat(last, n))


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``size`` as left-aligned ASCII digits, with room for a sign after them; their lengths."""
    texts = [str(i).encode() for i in range(size)]
    width = len(texts[-1]) + 1
    table = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(size, width)
    return table, np.array([len(t) for t in texts])


class Run:
    """The aligned tokens of a run of documents (``docs``: those that have tokens)."""

    def __init__(self, column: pa.Array, pair: Tokenizers, stretch: int = STRETCH):
        raw, offsets = text_bytes(column)
        self.n_docs = len(offsets) - 1
        filled = np.diff(offsets) > 0
        raw = np.insert(raw, offsets[:-1][filled], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        start = word_starts(raw, offsets)
        doc = np.searchsorted(offsets, start, "right") - 1
        at = np.append(start, len(raw)).astype(np.int64)
        words = pa.Array.from_buffers(
            pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw)]
        ).dictionary_encode()
        number = pair.numbers(words.dictionary.to_pylist())
        word = number[words.indices.to_numpy(zero_copy_only=False)] if len(start) else number
        whole = np.bincount(doc, ~pair.same[word], self.n_docs) == 0
        word, doc = word[whole[doc]], doc[whole[doc]]
        self.a, self.b = pair.ids(0, word), pair.ids(1, word)
        count_a, count_b = pair.count[0][word], pair.count[1][word]
        self.n_a = np.bincount(doc, count_a, self.n_docs).astype(np.int64)
        self.n_b = np.bincount(doc, count_b, self.n_docs).astype(np.int64)
        a_end, b_end = np.cumsum(pair.a_size[self.a]), np.cumsum(pair.b_size[self.b])
        self.over_a, self.over_b, self.cut_a, self.cut_b = lockstep(a_end, b_end, *_stretches(self.n_a, stretch))
        self.group_a = np.cumsum(self.cut_a) - self.cut_a
        self.group_b = np.cumsum(self.cut_b) - self.cut_b
        groups = int(self.cut_a.sum())
        self.in_a = np.bincount(self.group_a, minlength=groups)
        self.in_b = np.bincount(self.group_b, minlength=groups)
        # The document of each group is that of its last A token.
        self.doc_of_group = np.repeat(np.arange(self.n_docs), self.n_a)[self.cut_a]

    def per_doc(self, of_group: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_docs, np.int64)
        np.add.at(out, self.doc_of_group, of_group)
        return out

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links as (document, A id * 2^32 + B id, times), in parts; an id pair may come several times."""
        wide = (self.in_a > 1) & (self.in_b > 1)
        over = ~wide[self.group_a[self.over_a]]
        a, b = self.over_a[over], self.over_b[over]
        yield self.doc_of_group[self.group_a[a]], _pair(self.a[a], self.b[b]), np.ones(len(a), np.int64)
        if not wide.any():
            return
        # Distinct ids of the wide groups, and how often each is there.
        (g_a, id_a, n_a), (g_b, id_b, n_b) = (
            _distinct(group[wide[group]], ids[wide[group]])
            for group, ids in ((self.group_a, self.a), (self.group_b, self.b))
        )
        lo, hi = np.searchsorted(g_b, g_a, "left"), np.searchsorted(g_b, g_a, "right")
        # An A id's partners are taken in parts of at most WIDE.
        i = 0
        while i < len(g_a):
            total = np.cumsum((hi - lo)[i:])
            j = i + max(1, int(np.searchsorted(total, WIDE, "right")))
            n = (hi - lo)[i:j]
            left = np.repeat(np.arange(i, j), n)
            right = np.repeat(lo[i:j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield self.doc_of_group[g_a[left]], _pair(id_a[left], id_b[right]), n_a[left] * n_b[right]
            i = j

    def hashes(self, decimals: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """SHA-256 of each document's groups as text; '' without tokens."""
        table, length = decimals
        groups = len(self.in_a)
        before_b, through_a = np.cumsum(self.in_b) - self.in_b, np.cumsum(self.in_a)
        at_a = np.arange(len(self.a)) + (before_b[self.group_a] if groups else 0)
        at_b = np.arange(len(self.b)) + (through_a[self.group_b] if groups else 0)
        ids = np.empty(len(self.a) + len(self.b), np.int32)
        sign = np.empty(len(ids), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a] = np.where(self.cut_a, ord("|"), ord(","))
        sign[at_b] = np.where(self.cut_b, ord(";"), ord(","))
        letters, size = table[ids], length[ids]
        letters[np.arange(len(ids)), size] = sign
        text = letters[np.arange(table.shape[1]) <= size[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(size + 1)])
        last = np.cumsum(self.n_a + self.n_b)
        first = last - self.n_a - self.n_b
        return [
            hashlib.sha256(text[ends[i] : ends[j] - 1]).hexdigest() if j > i else ""
            for i, j in zip(first.tolist(), last.tolist())
        ]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(new)
    return group[at], ids[at], np.diff(np.append(at, len(ids)))


def _summed(
    parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]],
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (document, pair) rows of all parts as one, in order."""
    doc, key, times = (np.zeros(0, np.int64) for _ in range(3))
    for d, k, t in parts:
        doc, key, times = np.concatenate([doc, d]), np.concatenate([key, k]), np.concatenate([times, t])
        order = np.lexsort((key, doc))
        doc, key, times = doc[order], key[order], times[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        doc, key = doc[at], key[at]
        times = np.add.reduceat(times, at) if len(at) else times
    return doc, key, times


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers, kind).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _known_keys(keys: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(keys, "<i8"))


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the chunks: what each document has, and its links by id pair (``keys``, ``docs``: the chunk's pairs)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _tokenizers(a_path, b_path)
        decimals = _decimals(max(len(pair.a_bytes), len(pair.b_bytes)))
        for batch in batches:
            for piece in pieces(batch, "text", chunk_bytes):
                run = Run(piece["text"], pair)
                doc, key, times = _summed(run.links())
                keys, at = np.unique(key, return_inverse=True)
                docs = np.bincount(at, minlength=len(keys))
                lists = [
                    piece["doc_id"].cast(pa.int64()),
                    *[
                        pa.array(n)
                        for n in (
                            run.n_a,
                            run.n_b,
                            run.per_doc(np.ones(len(run.in_a), np.int64)),
                            run.per_doc(run.in_a * run.in_b),
                        )
                    ],
                    pa.array(run.hashes(decimals), pa.string()),
                ]
                ends = pa.array([0, piece.num_rows], pa.int32())
                blobs = [
                    _packed(np.diff(keys, prepend=0), "<i8"),
                    _packed(docs, "<u4"),
                    _packed(np.bincount(doc, minlength=piece.num_rows), "<u4"),
                    _packed(at, "<u4"),
                    _packed(times, "<u8"),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(ends, x) for x in lists] + [pa.array([x], pa.binary()) for x in blobs],
                    ["doc_ids", *_PLAIN, "hashes", "keys", "docs", "sizes", "at", "times"],
                )

    rows = docs.select("doc_id", "text").mapInArrow(align, CHUNKS)
    return settle(rows.withColumn("chunk", F.monotonically_increasing_id()), "aligned")


def _rows_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, keys, docs in zip(batch["chunk"].to_pylist(), batch["keys"], batch["docs"]):
            numbers = _known_keys(keys.as_py())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(numbers), chunk, np.int64)),
                    pa.array(numbers),
                    pa.array(_unpacked(docs.as_py(), "<u4").astype(np.int64)),
                ],
                ["chunk", "key", "docs"],
            )


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Per id pair of written chunks: ``key``, the documents that hold it, and whether none of its A id's has more."""
    rows = chunks.select("chunk", "keys", "docs").mapInArrow(_rows_of_keys, "chunk long, key long, docs long")
    sums = rows.groupBy("key").agg(F.sum("docs").alias("total"))
    # An A id has at most as many pairs as B has ids.
    of_a = Window.partitionBy(F.shiftright("key", 32))
    return settle(sums.select("key", "total", (F.col("total") == F.max("total").over(of_a)).alias("best")), "pairs")


def report(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: tokens, groups, links, links of the best pairs, sum of the links' counts, hash of the groups."""
    chunks = aligned(docs, a_path, b_path, chunk_bytes)
    rows = chunks.select("chunk", "keys", "docs").mapInArrow(_rows_of_keys, "chunk long, key long, docs long")
    back = rows.select("chunk", "key").join(pair_counts(chunks), "key")

    def finish(key: tuple, chunk: pa.Table, totals: pa.Table) -> pa.Table:
        found = {c: chunk[c][0].as_py() for c in ("keys", "sizes", "at", "times")}
        keys = _known_keys(found["keys"])
        order = np.argsort(totals["key"].to_numpy())
        if len(order) != len(keys):
            raise ValueError("a chunk's pairs did not all come back")
        total = totals["total"].to_numpy()[order]
        best = totals["best"].to_numpy()[order]
        sizes, at, times = (_unpacked(found[c], t) for c, t in (("sizes", "<u4"), ("at", "<u4"), ("times", "<u8")))
        doc, times = np.repeat(np.arange(len(sizes)), sizes), times.astype(np.int64)
        n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        np.add.at(n_best, doc, times * best[at])
        np.add.at(count_sum, doc, times * total[at])
        listed = {c: chunk[c].combine_chunks().flatten() for c in ("doc_ids", *_PLAIN, "hashes")}
        return pa.table(
            [listed["doc_ids"], *[listed[c] for c in _PLAIN], pa.array(n_best), pa.array(count_sum), listed["hashes"]],
            ["doc_id", *_PLAIN, "n_best", "count_sum", "groups_sha256"],
        )

    return chunks.drop("docs").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(finish, REPORT)


def links_of(text: str, a_path: str, b_path: str, make: Callable = Tokenizers) -> dict[tuple[int, int], int]:
    """Id pairs linked in one text, and how often: a small helper for looking at single texts."""
    run = Run(pa.array([text], pa.string()), make(a_path, b_path))
    _, key, times = _summed(run.links())
    return {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(n) for k, n in zip(key, times)}
