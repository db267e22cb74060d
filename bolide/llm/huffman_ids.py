"""Token ids as canonical, length-limited Huffman codes in independent blocks.

1. Documents are range-partitioned by doc_id and encoded with the tokenizer, the end
   id is appended, and the ids are written (``encoded``).
2. Counts of all ids give code lengths of at most ``MAX_BITS`` (package-merge); the
   canonical codes follow from the lengths alone. Counts and tables have one entry
   per id of the vocabulary: that bounds what the driver holds.
3. Runs of whole documents are blocks: the code bits, a checkpoint (bit offset) for
   every ``STRIDE``-th token, the documents' ids and lengths, and where the block starts
   among all ids. Any block decodes alone with one table of 2^MAX_BITS entries; all its
   checkpoints are decoded side by side.

The files are Parquet written by Spark: ``codes`` (id, length) and ``blocks``.

Defined cases: a null or empty text is only the end id. Null doc_ids come first; repeated
doc_ids are kept, each with its own start, in the order of the written table. A document
longer than a block makes a block of its own. An empty table gives empty files.
"""

from __future__ import annotations

import heapq
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bolide.llm.shared import pieces, span_hashes, text_bytes
from bolide.plans.settle import checkpoint_root, settle

MAX_BITS = 16
STRIDE = 256
# Text of a block's documents, in bytes.
BLOCK_BYTES = 2 << 20
# Spellings a worker process remembers.
REMEMBERED = 2_500_000
# New words that go to the tokenizer at a time.
NEW_WORDS = 20_000

RAW = "part int, before long, doc_ids array<bigint>, lengths array<int>, ids binary"
BLOCKS = (
    "part int, first_start long, bits binary, checkpoints binary, doc_ids array<bigint>, lengths array<int>"
)

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# Bytes of visible characters, and those that begin a character which is no white space (no first bytes of such).
_SHOWN = (np.arange(256) > 32) & (np.arange(256) < 127)
_LEADS = _SHOWN | (np.arange(256) >= 0xC3) & ~np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])


def _apart(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that must be encoded whole: with white space next to a space, or such beyond ASCII."""
    if not len(raw):
        return np.zeros(len(offsets) - 1, bool)
    space = raw == 32
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    bad = np.zeros(len(raw), bool)
    bad |= space & (edge[:-1] | edge[1:])
    bad[1:] |= space[1:] & _BLANK[raw[:-1]]
    bad[:-1] |= space[:-1] & _BLANK[raw[1:]]
    # First two bytes of any white space beyond ASCII.
    for lead, following in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        at = np.flatnonzero(raw[:-1] == lead)
        bad[at[np.isin(raw[at + 1], following)]] = True
    counts = np.concatenate([[0], np.cumsum(bad)])
    return counts[offsets[1:]] > counts[offsets[:-1]]


class _Grown:
    """Numbers in a row that more are put after; room is doubled, so that few are copied again."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self.n

    def add(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : end] = more
        self.n = end


class Encoder:
    """The tokenizer over whole texts, remembering what it gave for a word.

    A byte-level BPE splits a text before each single space between visible characters, and around each
    single line end between them, so the ids of a text are those of its space-led words and line ends in a row. Only words not met before
    go to the tokenizer; they are found by a hash and compared letter by letter. Texts with other white space
    around a space are encoded whole.
    """

    def __init__(self, tokenizer: str):
        # Tasks run side by side already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.line_end = self._encode(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        # Per word met: where its ids and letters are. ``known``, sorted, leads from a hash to the first word with it.
        self.first, self.letter = _Grown(np.int64), _Grown(np.int64)
        self.count, self.size = _Grown(np.int32), _Grown(np.int32)
        self.pool, self.letters = _Grown(np.uint32), _Grown(np.uint8)
        self.known, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of single words, and for each where its ids begin and how many it has.

        Words without line ends share calls, with line ends between them.
        """
        shared = [] if len(self.line_end) != 1 else [i for i, w in enumerate(words) if "\n" not in w]
        joined = ["\n".join([words[i] for i in shared[a : a + 500]]) for a in range(0, len(shared), 500)]
        parts = [np.array([*ids, *self.line_end], np.uint32) for ids in self._encode(joined)]
        alone = [i for i, w in enumerate(words) if "\n" in w] if len(self.line_end) == 1 else range(len(words))
        got = self._encode([words[i] for i in alone])
        ids = np.concatenate([*parts, np.fromiter(chain.from_iterable(got), np.uint32)])
        begin, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        # A line end after each shared word; the others come last.
        ends = np.flatnonzero(ids[: sum(map(len, parts))] == self.line_end[0])
        begin[shared], count[shared] = np.append(-1, ends[:-1]) + 1, np.diff(ends, prepend=-1) - 1
        sizes = np.array([len(g) for g in got], np.int64)
        begin[alone], count[alone] = len(ids) - sizes.sum() + np.cumsum(sizes) - sizes, sizes
        return ids, begin, count

    def _find(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each word, -1 for those not met; a word of equal hash but other letters is not it."""
        found = np.full(len(hashes), -1, np.int64)
        if not len(self.known):
            return found
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        entry = self.entry[at]
        like = np.flatnonzero((self.known[at] == hashes) & (self.size.room[entry] == size))
        entry, n = entry[like], size[like]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = raw[np.repeat(start[like], n) + step] != self.letters.room[np.repeat(self.letter.room[entry], n) + step]
        wrong = np.bincount(np.repeat(np.arange(len(like)), n), differ, len(like)) > 0
        found[like[~wrong]] = entry[~wrong]
        return found

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The entry of each of the distinct ``words``; new ones are encoded."""
        raw, offsets = text_bytes(words)
        start, size = offsets[:-1], np.diff(offsets)
        hashes = span_hashes(raw, start, offsets[1:], [None])[0]
        found = self._find(hashes, raw, start, size)
        fresh = np.flatnonzero(found < 0)
        if len(self.first) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = np.arange(len(words))
        if not len(fresh):
            return found
        n = size[fresh]
        entry = len(self.first) + np.arange(len(fresh))
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.letter.add(len(self.letters) + np.cumsum(n) - n)
        self.size.add(n)
        self.letters.add(raw[np.repeat(start[fresh], n) + step])
        spelled = words.take(pa.array(fresh)).to_pylist()
        for i in range(0, len(spelled), NEW_WORDS):
            got, begin, count = self._of_words(spelled[i : i + NEW_WORDS])
            self.first.add(len(self.pool) + begin)
            self.count.add(count)
            self.pool.add(got)
        # Of words with one hash the first leads; others are encoded anew when they come again.
        new, one = np.unique(hashes[fresh], return_index=True)
        at = np.searchsorted(self.known, new)
        there = np.zeros(len(new), bool)
        if len(self.known):
            there = self.known[np.minimum(at, len(self.known) - 1)] == new
        self.known = np.insert(self.known, at[~there], new[~there])
        self.entry = np.insert(self.entry, at[~there], entry[one[~there]].astype(np.int32))
        found[fresh] = entry
        return found

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        raw, offsets = text_bytes(column)
        n = len(offsets) - 1
        whole = _apart(raw, offsets)
        begins = raw == 32
        filled = offsets[:-1][np.diff(offsets) > 0]
        begins[filled] = True
        # Seen across the end of a text, which is a cut anyway, this is right as well.
        line = np.flatnonzero(raw[1:-1] == 10) + 1
        line = line[_SHOWN[raw[line - 1]] & _LEADS[raw[line + 1]]]
        begins[line] = begins[line + 1] = True
        start = np.flatnonzero(begins)
        doc = np.repeat(np.arange(n), np.diff(np.searchsorted(start, offsets)))
        at = np.append(start, len(raw)).astype(np.int64)
        spelled = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw)])
        if whole.any():
            plain = ~whole[doc]
            spelled, doc = spelled.filter(pa.array(plain)), doc[plain]
        words = spelled.dictionary_encode()
        number = self._numbers(words.dictionary)
        word = number[words.indices.to_numpy(zero_copy_only=False)] if len(doc) else number
        count = self.count.room[word]
        place = np.repeat(self.first.room[word] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        numbers, lengths = self.pool.room[place], np.bincount(doc, count, n).astype(np.int64)
        if not whole.any():
            return numbers, lengths
        parts = np.split(numbers, np.cumsum(lengths)[:-1])
        odd = np.flatnonzero(whole)
        data = raw.tobytes()
        texts = [data[offsets[d] : offsets[d + 1]].decode() for d in odd]
        for d, ids in zip(odd, self._encode(texts)):
            parts[d] = np.array(ids, np.uint32)
            lengths[d] = len(ids)
        return np.concatenate(parts), lengths


def _encoder(tokenizer: str) -> Encoder:
    """The worker process's encoder: later tasks of the process find the words of earlier ones."""
    import tokenizers

    held = vars(tokenizers).setdefault("_corpus_encoders", {})
    if tokenizer not in held:
        held[tokenizer] = Encoder(tokenizer)
    return held[tokenizer]


def _ended(numbers: np.ndarray, lengths: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with the end id after them."""
    if end_id is None:
        return numbers, lengths
    return np.insert(numbers, np.cumsum(lengths), end_id), lengths + 1


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """Write the ids of all texts in doc_id order, a row for a run of documents.

    ``before`` counts the ids of the same range partition before the row's.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(tokenizer), 0
        for batch in batches:
            for piece in pieces(batch, "text", BLOCK_BYTES):
                numbers, lengths = _ended(*encoder.ids(piece["text"]), end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["part"].slice(0, 1),
                        pa.array([before], pa.int64()),
                        pa.array([piece["doc_id"].cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
                        pa.array([lengths], pa.list_(pa.int32())),
                        pa.array([_squeezed(numbers)], pa.binary()),
                    ],
                    ["part", "before", "doc_ids", "lengths", "ids"],
                )
                before += len(numbers)

    ordered = (
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
        .repartitionByRange(parts, "doc_id", "_row")
        .sortWithinPartitions("doc_id", "_row")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    return settle(ordered.mapInArrow(encode, RAW), "ids")


def _squeezed(ids: np.ndarray) -> bytes:
    """Until the code is known: 16-bit numbers where they fit, packed."""
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"2" if narrow else b"4") + zstandard.compress(ids.astype("<u2" if narrow else "<u4").tobytes(), 3)


def _unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), "<u2" if data[:1] == b"2" else "<u4")


def id_counts(ids: DataFrame) -> dict[int, int]:
    """How often each id occurs: partial counts per task, then one row per id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch["ids"]:
                part = np.bincount(_unsqueezed(blob.as_py()))
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), np.int64)])
                total[: len(part)] += part
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"]
        )

    partial = ids.select("ids").mapInArrow(count, "id long, n long")
    # One row per id of the vocabulary.
    return {r["id"]: r["n"] for r in partial.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``max_bits``, by package-merge; ties go by id."""
    items = sorted((n, i) for i, n in counts.items())
    if len(items) <= 1:
        return {i: 1 for _, i in items}
    if len(items) > 1 << max_bits:
        raise ValueError(f"{len(items)} ids don't fit codes of {max_bits} bits")
    leaves = [(n, (k,)) for k, (n, _) in enumerate(items)]
    # A package is a count and how it was made: a leaf (k,) or a pair of packages.
    row = leaves
    for _ in range(max_bits - 1):
        pairs = [(a[0] + b[0], (a, b)) for a, b in zip(row[::2], row[1::2])]
        row = list(heapq.merge(leaves, pairs, key=lambda p: p[0]))
    lengths = [0] * len(items)
    stack = [p for p in row[: 2 * len(items) - 2]]
    while stack:
        made = stack.pop()[1]
        if len(made) == 1:
            lengths[made[0]] += 1
        else:
            stack.extend(made)
    return {i: length for (_, i), length in zip(items, lengths)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in code order, their lengths and codes: shorter first, then by id."""
    order = sorted(lengths, key=lambda i: (lengths[i], i))
    codes, code, last = [], 0, 0
    for i in order:
        code <<= lengths[i] - last
        codes.append(code)
        code, last = code + 1, lengths[i]
    return (
        np.array(order, np.int64),
        np.array([lengths[i] for i in order], np.int64),
        np.array(codes, np.int64),
    )


class Codebook:
    """Tables for coding and decoding, from the code lengths alone."""

    def __init__(self, lengths: dict[int, int]):
        order, bits, codes = canonical(lengths)
        top = int(order.max()) + 1 if len(order) else 1
        self.code, self.bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[order], self.bits[order] = codes.astype(np.uint64), bits
        # Each code owns the run of table entries that begin with its bits.
        self.symbol = np.zeros(1 << MAX_BITS, np.uint32)
        self.length = np.ones(1 << MAX_BITS, np.int64)
        runs = 1 << (MAX_BITS - bits)
        filled = int(runs.sum())
        self.symbol[:filled] = np.repeat(order.astype(np.uint32), runs)
        self.length[:filled] = np.repeat(bits, runs)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits of ``ids``, high bit first in 32-bit words, and the checkpoints."""
        width = self.bits[ids]
        at = np.concatenate([[0], np.cumsum(width)])
        words = np.zeros((int(at[-1]) >> 5) + 3, np.uint64)
        # A code of at most 16 bits lies in two neighbouring words: as 64 bits, high word first.
        place = self.code[ids] << (64 - (at[:-1] & 31) - width).astype(np.uint64)
        word = at[:-1] >> 5
        if len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            both = np.bitwise_or.reduceat(place, first)
            words[word[first]] |= both >> np.uint64(32)
            words[word[first] + 1] |= both & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes(), at[:-1:STRIDE].astype("<u8").tobytes()

    def decode(self, data: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """``n`` ids: every checkpoint is a lane, and all lanes step together."""
        words = np.frombuffer(data, ">u4").astype(np.uint64)
        pos = np.frombuffer(checkpoints, "<u8").astype(np.int64)
        lanes = len(pos)
        out = np.zeros((lanes, STRIDE), np.uint32)
        tail = n - (lanes - 1) * STRIDE if lanes else 0
        for step in range(STRIDE):
            live = lanes if step < tail else lanes - 1
            if live <= 0:
                break
            p = pos[:live]
            w = p >> 5
            window = (words[w] << np.uint64(32)) | words[w + 1]
            shift = (64 - MAX_BITS - (p & 31)).astype(np.uint64)
            entry = ((window >> shift) & np.uint64((1 << MAX_BITS) - 1)).astype(np.int64)
            out[:live, step] = self.symbol[entry]
            pos[:live] = p + self.length[entry]
        return out.reshape(-1)[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None) -> None:
    """Write ``docs`` as coded ids under ``path``: folders ``codes`` and ``blocks``."""
    spark = docs.sparkSession
    ids = encoded(docs, tokenizer, end_id)
    lengths = code_lengths(id_counts(ids))
    spark.createDataFrame(sorted(lengths.items()), "id long, length int").coalesce(1).write.parquet(
        f"{path}/codes"
    )
    book = spark.sparkContext.broadcast(lengths)  # one entry per id of the vocabulary
    # Tokens before each range partition: one number per partition.
    sizes = F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x)
    totals = {r[0]: r[1] for r in ids.groupBy("part").agg(F.sum(sizes)).collect()}
    parts = sorted(totals)
    before = dict(zip(parts, accumulate([0, *(totals[p] for p in parts)])))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook = Codebook(book.value)
        for batch in batches:
            coded = [codebook.encode(_unsqueezed(b.as_py())) for b in batch["ids"]]
            starts = [before[p] + b for p, b in zip(batch["part"].to_pylist(), batch["before"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["part"],
                    pa.array(starts, pa.int64()),
                    pa.array([c[0] for c in coded], pa.binary()),
                    pa.array([c[1] for c in coded], pa.binary()),
                    batch["doc_ids"],
                    batch["lengths"],
                ],
                ["part", "first_start", "bits", "checkpoints", "doc_ids", "lengths"],
            )

    ids.mapInArrow(pack, BLOCKS).write.parquet(f"{path}/blocks")


def read_lengths(spark: SparkSession, path: str) -> dict[int, int]:
    return {r["id"]: r["length"] for r in spark.read.parquet(f"{path}/codes").collect()}


def decoded(spark: SparkSession, path: str, form: str = "ids") -> DataFrame:
    """Read the files back: doc_id, start, n_tokens and ``ids``, or with ``form="crc"`` their CRC."""
    book = spark.sparkContext.broadcast(read_lengths(spark, path))
    kind = pa.list_(pa.int64()) if form == "ids" else pa.int64()
    name = "ids" if form == "ids" else "ids_crc32"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook = Codebook(book.value)
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths = batch["doc_ids"][row].as_py(), batch["lengths"][row].as_py()
                starts = batch["first_start"][row].as_py() + np.cumsum([0, *lengths[:-1]])
                n = sum(lengths)
                numbers = codebook.decode(batch["bits"][row].as_py(), batch["checkpoints"][row].as_py(), n)
                each = np.split(numbers, np.cumsum(lengths)[:-1])
                values = [
                    e.tolist() if form == "ids" else zlib.crc32(e.astype("<u4").tobytes()) for e in each
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(values, kind),
                    ],
                    ["doc_id", "start", "n_tokens", name],
                )

    blocks = spark.read.parquet(f"{path}/blocks").drop("part")
    return blocks.mapInArrow(
        unpack,
        f"doc_id long, start long, n_tokens long, {name} {'array<bigint>' if form == 'ids' else 'long'}",
    )


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/bolide/coded-{uuid.uuid4().hex}"
