"""What signing, encoding and indexing do and hold, beside what they return."""

import tracemalloc

import numpy as np
import pyarrow as pa

from bolide.llm import icws_dedup, quality_mil
from bolide.llm.exchange import key48
from bolide.llm.shared import Words

TEXTS = ["a b c d e f a b c d e f", "", "x y", "B c d e f a, b c", None, "one two three four five", "x y"]


def _plain(words, weights):
    """Shingles one by one."""
    hashes, found = words.hashes(), {}
    for d, (a, b) in enumerate(zip(words.bounds, words.bounds[1:])):
        for at in range(a, max(a + min(1, b - a), b - 4)):
            h, w = np.zeros(1, np.uint64), 0
            for k in range(min(5, b - a)):
                h = icws_dedup.mixed(h + hashes[at + k] + np.uint64(k + 1))
                w += int(weights[at + k])
            found[d, int(h[0])] = found.get((d, int(h[0])), 0) + w
    return sorted((d, h, w) for (d, h), w in found.items())


def test_only_chosen_documents_get_shingles():
    words = Words(pa.array(TEXTS))
    assert words.hashes() is words.hashes()  # hashed once
    weights = np.arange(1, len(words) + 1)
    want = _plain(words, weights)
    every = icws_dedup.shingles(words, weights)
    assert [*zip(*(x.tolist() for x in every))] == want
    chosen = np.array([True, True, False, False, True, True, True])
    some = icws_dedup.shingles(words, weights, chosen)
    assert [*zip(*(x.tolist() for x in some))] == [r for r in want if chosen[r[0]]]
    none = icws_dedup.shingles(words, weights, np.zeros(len(TEXTS), bool))
    assert [len(x) for x in none] == [0, 0, 0]


def test_hashes_with_equal_leading_bits_are_in_order():
    h = np.array([3, 1, 2, 1 << 60, 0, 7, 5], np.uint64)
    doc = np.array([0, 0, 0, 1, 1, 4, 4])
    order = icws_dedup._in_order(doc, h, 5)
    assert [*zip(doc[order].tolist(), h[order].tolist())] == sorted(zip(doc.tolist(), h.tolist()))


def test_words_per_document_are_counted_once():
    for texts in (TEXTS, [], [None, ""]):
        words = Words(pa.array(texts, pa.string()))
        keys, n = icws_dedup._distinct_keys(words)
        pairs = set(zip(key48(words.hashes()).tolist(), words.doc().tolist()))
        want = {}
        for k, _ in pairs:
            want[k] = want.get(k, 0) + 1
        assert keys.tolist() == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]


def _peak(make):
    tracemalloc.start()
    try:
        make()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_spelling_words_holds_little_beside_the_text():
    words = Words(pa.array(["some plain words, " * 60_000]))
    assert words.spelled().to_pylist()[:3] == [b"some", b"plain", b"words"]
    assert _peak(words.spelled) < 8 * len(words.raw)  # 17 times with two numbers for each byte


def test_texts_reach_the_classifier_once_and_in_small_pieces(spark):
    docs = spark.createDataFrame([(1, "good words. " * 30), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r["doc_id"] for r in quality_mil.keep_good(docs, labels, 0.0).orderBy("doc_id").collect()] == [1, 2]
    plan = quality_mil.keep_good(docs, labels)._jdf.queryExecution().analyzed().toString()
    sent = [line for line in plan.splitlines() if "Project [struct(" in line or "AS _doc" in line]
    assert sent and not any("text#" in line.split("struct(")[0] for line in sent)
    text = pa.array(["good words, and more of them. " * 30] * 4000)
    batch = pa.RecordBatch.from_arrays([text], ["text"])
    part = next(quality_mil.pieces(batch, "text", quality_mil.PIECE_BYTES))
    assert _peak(lambda: quality_mil.encode(part["text"])) < 100 << 20  # 181 with four times the text


def test_only_shared_keys_of_lines_are_kept(spark, monkeypatch):
    """Every key of every line was joined with its line, written and moved again, though most have one line."""
    from bolide.llm import line_dedup

    words = [f"word{i}" for i in range(400)]
    lines = [" ".join(words[i : i + 12]) for i in range(0, 384, 12)]
    texts = [("a", "\n".join(lines[:16])), ("b", "\n".join([*lines[16:], lines[0] + " more", lines[0]]))]
    kept = {}
    plain = line_dedup.settle

    def noting(df, label="round"):
        kept[label] = plain(df, label)
        return kept[label]

    monkeypatch.setattr(line_dedup, "settle", noting)
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    found = {r.doc_id: r.dropped_lines for r in line_dedup.report(docs).collect()}
    assert found == {"a": "", "b": "16,17"}
    keyed = kept["keyed"].select("key", "id").collect()
    of = {}
    for r in keyed:
        of.setdefault(r.key, []).append(r.id)
    assert of and all(len(ids) == len(set(ids)) > 1 for ids in of.values())
    assert {"simhash", "size", "loose"} <= set(kept["keyed"].columns)


def test_shared_keys_count_ids_once(spark):
    from bolide.llm import line_dedup

    rows = [(1, 7), (2, 7), (2, 7), (3, 8), (4, 9), (5, 9), (6, 9)]
    got = line_dedup.shared_keys(spark.createDataFrame(rows, "id long, key long")).collect()
    assert sorted((r.id, r.key) for r in got) == [(1, 7), (2, 7), (4, 9), (5, 9), (6, 9)]
