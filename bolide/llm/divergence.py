"""Audit of how sources diverge in vocabulary, with terms as digests until the last step.

1. Tasks cut runs of documents into terms and count them per (language, source) and term; a
   term goes out with a 64-bit digest. These local counts are written once.
2. Counts are shuffled by digest only, numbers of fixed width. The smallest and the largest string
   of each digest tell whether different terms met in it; the terms of such a digest get numbers of their
   own (``part``), so it is split and counts stay exact.
3. A language keeps its terms in at least ``MIN_DOCS`` documents. A group's smoothed rate of a term is
   p = 1 + floor(SCALE (count + 1) / (N + V)) in whole numbers, q that of another group or
   of the whole language, and a term's divergence is floor((p - q)^2 / q).
4. ``pair``: summed over all kept terms, each source against each other one of its language. Pieces of a
   language's vocabulary meet stripes of its sources as dense blocks, so no pair of sources
   is formed per term; a block's rows are the sums alone.
5. ``term``: the terms that a source uses more than its language does, the first ``TOP`` by value. Ranks are
   found on digests; only terms that reach the last rank's value are joined with their text.

Defined cases: null text, lang and source are ''. A group without terms has its pairs and no
terms; a language without kept terms has pairs of value 0. Repeated rows count as documents of
their own. An empty table gives no rows. The pairs of a language's sources are the square of
their number, as asked; a task holds a stripe of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bolide.llm.shared import pieces, text_bytes
from bolide.plans.settle import settle

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
DIGEST_BITS = 64
# Text whose terms one local count covers.
PIECE_BYTES = 16 << 20
# Sources of one stripe, and numbers of one dense block of terms x sources.
STRIPE = 256
BLOCK = 1 << 22
# Terms of a vocabulary piece, at least and at most.
PIECE_TERMS = (64, 4096)

LOCAL = "lang string, source string, term string, n long, docs long"
GROUP = ["lang", "source"]
KEY = ["lang_no", "digest", "part"]


def _letters() -> np.ndarray:
    low = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 0x80 or ord("a") <= b <= ord("z"):
            low[b] = b
        elif ord("A") <= b <= ord("Z"):
            low[b] = b + 32
    return low


LETTERS = _letters()


def local_counts(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per run of documents, group and term: its occurrences and documents there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", piece_bytes):
                yield _counted(piece)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]
    return docs.select(*named, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, LOCAL)


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = text_bytes(batch["text"])
    low = LETTERS[raw]
    inside = low > 0
    edges = np.zeros(len(raw) + 1, bool)
    edges[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edges[1:-1]
    start = np.flatnonzero(first)
    # Terms lie end to end once all else is left out.
    letters = low[inside]
    before = np.cumsum(inside) - inside
    at = np.append(before[start], len(letters)).astype(np.int64)
    terms = pa.Array.from_buffers(
        pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(letters)]
    ).dictionary_encode()
    doc = np.searchsorted(offsets, start, "right") - 1
    groups = pa.StructArray.from_arrays([batch[c] for c in GROUP], GROUP)
    group, which = _numbered(groups)
    size = max(1, len(terms.dictionary))
    term = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    in_doc, n_in_doc = np.unique(doc * size + term, return_counts=True)
    key = which[in_doc // size] * size + in_doc % size
    found, back = np.unique(key, return_inverse=True)
    n = np.bincount(back, n_in_doc, len(found)).astype(np.int64)
    docs = np.bincount(back, minlength=len(found)).astype(np.int64)
    rows = group.take(pa.array(found // size))
    return pa.RecordBatch.from_arrays(
        [
            *[pc.struct_field(rows, c) for c in GROUP],
            terms.dictionary.take(pa.array(found % size)).cast(pa.string()),
            pa.array(n),
            pa.array(docs),
        ],
        [*GROUP, "term", "n", "docs"],
    )


def _numbered(rows: pa.StructArray) -> tuple[pa.StructArray, np.ndarray]:
    """Distinct rows of strings, and the number of each row's one."""
    codes, sizes, values = [], [], []
    for field in rows.flatten():
        coded = field.dictionary_encode()
        codes.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        sizes.append(max(1, len(coded.dictionary)))
        values.append(coded.dictionary)
    number = codes[0] * sizes[1] + codes[1]
    found, which = np.unique(number, return_inverse=True)
    parts = [values[0].take(pa.array(found // sizes[1])), values[1].take(pa.array(found % sizes[1]))]
    return pa.StructArray.from_arrays(parts, [f.name for f in rows.type]), which


def digest_of(term: Column, bits: int = DIGEST_BITS) -> Column:
    """A 64-bit number, or the first ``bits`` of it."""
    return F.xxhash64(term) if bits >= 64 else F.shiftrightunsigned(F.xxhash64(term), 64 - bits)


def numbered_groups(docs: DataFrame) -> DataFrame:
    """Write every occurring group: lang, source, lang_no, grp (all numbered) and place in its language."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]
    found = docs.select(*named).distinct()
    # One row a group from here on.
    by_lang = Window.partitionBy("lang").orderBy("source")
    langs = found.select("lang").distinct().withColumn("lang_no", F.monotonically_increasing_id())
    rows = found.withColumn("place", F.row_number().over(by_lang) - 1)
    rows = rows.join(settle(langs, "langs"), "lang").withColumn("grp", F.monotonically_increasing_id())
    return settle(rows, "groups")


def split_digests(local: DataFrame) -> DataFrame:
    """Terms of digests that hold more than one: digest, term and its number ``part``.

    A digest's smallest and largest string differ exactly if it holds several.
    """
    ends = local.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    met = settle(ends.filter("low <> high").select("digest"), "collisions")
    terms = local.select("digest", "term").join(met, "digest", "left_semi").distinct()
    order = Window.partitionBy("digest").orderBy("term")
    return settle(terms.withColumn("part", F.row_number().over(order).cast("int")), "split")


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = DIGEST_BITS
) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    groups = numbered_groups(docs)
    local = settle(local_counts(docs).withColumn("digest", digest_of(F.col("term"), bits)), "local")
    split = split_digests(local)
    sure = local.join(groups.select(*GROUP, "grp", "lang_no"), GROUP)
    if split.isEmpty():
        sure = sure.withColumn("part", F.lit(0))
    else:
        sure = sure.join(split, ["digest", "term"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    # From here on digests only.
    counts = sure.groupBy("grp", *KEY).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy(*KEY)
    kept = (
        counts.withColumn("lang_docs", F.sum("docs").over(of_term))
        .withColumn("lang_n", F.sum("n").over(of_term))
        .withColumn("lead", F.col("grp") == F.min("grp").over(of_term))
        .filter(F.col("lang_docs") >= min_docs)
        .select("grp", *KEY, "n", "lang_n", "lead")
    )
    kept = settle(kept, "kept")
    sizes = _sizes(kept, groups)
    rated = kept.join(sizes.select("grp", "place", "total", "vocabulary", "lang_total", "sources"), "grp")
    rated = rated.withColumn("p", rate(F.col("n"), F.col("total"), F.col("vocabulary")))
    names = sizes.select("grp", "lang_no", "place", *GROUP)
    pairs = _pairs(rated, sizes, names)
    return pairs.unionByName(_terms(rated, local, split, names, top))


def rate(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + vocabulary)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = (wide(count) + 1) * F.lit(SCALE).cast("decimal(10,0)")
    below = wide(total) + wide(vocabulary)
    return F.call_function("div", over, below) + 1


def _sizes(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group its N (total), its language's V, N and number of sources, and the rate of a term it lacks."""
    own = kept.groupBy("grp").agg(
        F.sum("n").alias("total"), F.sum(F.col("lead").cast("long")).alias("leads")
    )
    lang = Window.partitionBy("lang_no")  # a row per group
    rows = groups.join(own, "grp", "left").fillna(0, ["total", "leads"])
    rows = rows.withColumn("vocabulary", F.sum("leads").over(lang))
    rows = rows.withColumn("lang_total", F.sum("total").over(lang))
    rows = rows.withColumn("sources", F.count(F.lit(1)).over(lang))
    lacking = F.when(F.col("vocabulary") > 0, rate(F.lit(0), F.col("total"), F.col("vocabulary")))
    return settle(rows.drop("leads").withColumn("p0", lacking), "sizes")


def _pairs(rated: DataFrame, sizes: DataFrame, names: DataFrame) -> DataFrame:
    """Ranked pairs. A block is a piece of a vocabulary and a stripe of sources against all sources."""
    low, high = PIECE_TERMS
    per_piece = F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.lit(BLOCK) / F.col("sources"))))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / per_piece)).cast("int")
    n_stripes = F.ceil(F.col("sources") / STRIPE).cast("int")
    stripes = F.explode(F.sequence(F.lit(0), n_stripes - 1))
    # Only languages with kept terms have blocks.
    terms = rated.select(
        "lang_no",
        F.pmod(F.xxhash64("digest", "part"), n_pieces).cast("int").alias("piece"),
        "digest",
        "part",
        F.col("place").cast("int").alias("place"),
        "p",
        stripes.alias("stripe"),
    )
    block = ["lang_no", "piece", "stripe"]
    # Absent terms need each source's rate for them: one number a source, to each block.
    blocks = sizes.filter("vocabulary > 0").select(
        "lang_no",
        F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece"),
        F.col("place").cast("int").alias("place"),
        "p0",
        "sources",
        stripes.alias("stripe"),
    )
    stripe = STRIPE

    def block_sums(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
        names = ["lang_no", "place", "other", "value"]
        if not len(terms) or not len(sources):
            return pa.table([pa.array([], pa.int64())] * 4, names)
        number = sources["place"].to_numpy()
        absent = np.zeros(len(number), np.int64)
        absent[number] = sources["p0"].to_numpy()
        lo = key[2].as_py() * stripe
        hi = min(lo + stripe, len(absent))
        named = np.rec.fromarrays([terms["digest"].to_numpy(), terms["part"].to_numpy()])
        found, row = np.unique(named, return_inverse=True)
        dense = np.tile(absent, (len(found), 1))
        dense[row, terms["place"].to_numpy()] = terms["p"].to_numpy()
        sums = np.empty((hi - lo, len(absent)), np.int64)
        for g in range(lo, hi):
            apart = dense[:, g : g + 1] - dense
            sums[g - lo] = (apart * apart // dense).sum(0)
        mine, others = np.divmod(np.arange(sums.size), len(absent))
        mine += lo
        different = mine != others
        return pa.table(
            [
                pa.array(np.full(different.sum(), key[0].as_py(), np.int64)),
                pa.array(mine[different].astype(np.int64)),
                pa.array(others[different].astype(np.int64)),
                pa.array(sums.reshape(-1)[different]),
            ],
            names,
        )

    parts = (
        terms.groupBy(*block)
        .cogroup(blocks.groupBy(*block))
        .applyInArrow(block_sums, "lang_no long, place long, other long, value long")
    )
    summed = parts.groupBy("lang_no", "place", "other").agg(F.sum("value").alias("value"))
    # Languages without kept terms: their pairs have the value 0.
    bare = sizes.filter("vocabulary = 0 and sources > 1").select("lang_no", F.col("place").cast("long"), "sources")
    bare = bare.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sources") - 1)))
    bare = bare.filter("other <> place").select("lang_no", "place", "other", F.lit(0).cast("long").alias("value"))
    mine = names.select("lang_no", F.col("place").cast("long").alias("place"), *GROUP)
    theirs = mine.select("lang_no", F.col("place").alias("other"), F.col("source").alias("item"))
    every = summed.unionByName(bare).join(mine, ["lang_no", "place"]).join(theirs, ["lang_no", "other"])
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return every.select(
        *GROUP, F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def _terms(rated: DataFrame, local: DataFrame, split: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """Ranked terms. The text of a term is looked up only where its value reaches the last rank's."""
    q = rate(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    over = rated.withColumn("q", q).filter("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    over = settle(over.select("grp", "digest", F.col("part"), value.alias("value")), "over")
    by_value = Window.partitionBy("grp").orderBy(F.desc("value"))
    firsts = over.withColumn("r", F.row_number().over(by_value)).filter(F.col("r") <= top)
    least = firsts.groupBy("grp").agg(F.min("value").alias("least"))
    wanted = settle(over.join(least, "grp").filter("value >= least").drop("least"), "wanted")
    spelled = local.select("digest", "term").join(wanted.select("digest").distinct(), "digest", "left_semi").distinct()
    if split.isEmpty():
        spelled = spelled.withColumn("part", F.lit(0))
    else:
        spelled = spelled.join(split, ["digest", "term"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    texts = wanted.join(spelled, ["digest", "part"])
    order = Window.partitionBy("grp").orderBy(F.desc("value"), "term")
    ranked = texts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(names.select("grp", *GROUP), "grp").select(
        *GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"
    )
