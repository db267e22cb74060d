"""Words that a weak hash takes for one another, samples with odd rows, and the pipeline from end to end."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from bolide.llm import huffman_ids, lm_difference, phrase_index, shared

END = 2


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


A, B = thue_morse(4096), thue_morse(4096, "ba")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_span_hashes_tell_words_apart():
    texts = ["hello", "hello\0", "hello\0\0", A, B, A + "\0", "", "\0"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    whole, first = shared.span_hashes(data, start, end, [None, 5])
    assert len(set(whole.tolist())) == len(texts)
    assert first[0] == first[1] == first[2] != 0 and first[7] == 0 and whole[0] == first[0]


def test_ids_are_the_tokenizers(spark, tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    bits = ["hello", "hello\0", "\0", " ", "  ", "\n", "\t", " ", "　", "é", "12", "<|endoftext|>", "日本", A, B]
    texts = ["hello", "hello\0", "x hello y", "x hello\0 y", A, B, f"x {A} {B}", f"{B} {A}", None, "", " ", "w " * 3000]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    texts += texts[:3]
    plain = Tokenizer.from_file(tokenizer)
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, END]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = huffman_ids.new_folder(spark)
    huffman_ids.write_ids(docs, path, tokenizer, END)
    got = {r["doc_id"]: tuple(r)[1:] for r in huffman_ids.decoded(spark, path, "crc").collect()}
    assert got == want
    monkeypatch.setattr(huffman_ids, "REMEMBERED", 40)
    import pyarrow as pa

    for hashes in (huffman_ids.span_hashes, lambda raw, a, b, p: [np.zeros(len(a), np.uint64)]):
        monkeypatch.setattr(huffman_ids, "span_hashes", hashes)  # the other: all words have one hash
        encoder = huffman_ids.Encoder(tokenizer)
        for i in range(0, len(texts), 7):
            ids, lengths = encoder.ids(pa.array(texts[i : i + 7], pa.string()))
            want = [x for t in texts[i : i + 7] for x in plain.encode(t or "", add_special_tokens=False).ids]
            assert ids.tolist() == want and lengths.sum() == len(ids)


def test_line_ends_between_visible_characters_cut_words(tokenizer):
    import pyarrow as pa

    texts = ["a.\nOne two.\nOne", "two.\n", "\nOne", "é\nOne", "two.\n\nOne", "two.\n　One", None]
    encoder = huffman_ids.Encoder(tokenizer)
    ids, lengths = encoder.ids(pa.array(texts))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == [len(w) for w in want]
    again = huffman_ids.Encoder(tokenizer)
    again.ids(pa.array(texts[:1]))
    # "a.", line end, "One", " two."
    assert len(again.first) == 4


def test_ids_of_an_empty_table(spark, tokenizer):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = huffman_ids.new_folder(spark)
    huffman_ids.write_ids(docs, path, tokenizer, END)
    assert huffman_ids.decoded(spark, path, "crc").count() == 0


def test_phrases_of_like_words(spark):
    bench = spark.createDataFrame([("q", B), ("z", f"one {B} two")], "item_id string, text string")
    docs = spark.createDataFrame([(1, A), (2, f"x {A}"), (3, f"x {B}"), (4, f"one {A} two")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in phrase_index.report(docs, bench).collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (1, True), 4: (0, False)}


def test_near_matches_at_the_start_of_a_text(spark):
    bench = spark.createDataFrame([("q", "one two three four")], "item_id string, text string")
    docs = spark.createDataFrame(
        [(1, "two one three four"), (2, "x one two three four"), (3, "two three four")], "doc_id long, text string"
    )
    got = {r["doc_id"]: (r["n_hit"], r["n_near_items"]) for r in phrase_index.report(docs, bench).collect()}
    assert got == {1: (0, 1), 2: (4, 0), 3: (0, 0)}


def test_sample_passes_over_what_does_not_fit(spark):
    n = 40
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:n]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    texts = [(i, "x" * 5000 if k in (0, 5) else f"text {i}") for k, i in enumerate(ids)]
    texts += [(ids[1], f"text {ids[1]} again")] * 30 + [(None, "none"), (ids[2], None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = shared.labelled_sample(docs, labels, "quality", 1000, 1000).collect()
    assert len(rows) == n - 2 and sum(len(r["text"]) for r in rows) <= 1000
    assert shared.labelled_sample(docs, labels, "quality", 10, 10**6).count() == 10
    assert shared.labelled_sample(docs, labels.limit(0), "quality", 10, 10**6).count() == 0


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables of which is known what each stage must take away; returns (folder, ids that stay)."""
    rng = random.Random(9)
    good = {i: prose(rng, 120) for i in range(60)}
    junk = {i: " ".join(w + "*** $$$" for w in prose(rng, 80).split()) for i in range(100, 140)}
    passage = prose(rng, 14)
    rows = [(i, t) for i, t in [*good.items(), *junk.items()]]
    rows += [(200 + i, good[i].replace(" ", " \n", 3)) for i in range(5)]  # copies but for white space
    rows += [(210 + i, good[10 + i] + " tail") for i in range(5)]  # near copies
    rows += [(220 + i, prose(rng, 50) + " " + passage.upper() + " " + prose(rng, 50)) for i in range(3)]
    rows += [(3, good[3]), (None, good[4]), (300, None), (301, "")]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", "s", len(t or ""), 7, 8) for i, t in rows]
    form = "doc_id long, text string, lang string, source string, n_chars long, _row long, digest long"
    spark.createDataFrame(docs, form).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, 0) for i in good] + [(i, 0, 0) for i in junk]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench = spark.createDataFrame([("a", passage)], "item_id string, text string")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return folder, set(good)


def test_pipeline_from_end_to_end(spark, corpus):
    folder, stays = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    form = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, docs, folder)
        assert kept.columns == form
        path = f"{folder}/stage{number}"
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert stays <= left
        assert not left & set(range(100, 140))
        assert number < 1 or docs.count() == len(left) and not left & {None, *range(200, 205)}
        assert number < 2 or not left & set(range(210, 215))
        assert number < 3 or not left & {220, 221, 222}
    empty = stays | {i for i in left if i in (300, 301)}
    assert left == empty
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == left
    words = {}
    for r in rows:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert all(words[i] == 120 for i in stays)


def test_pipeline_on_empty_tables(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_background_losses_follow_the_counts(spark):
    """Equal texts have equal losses, and texts made of frequent pairs lower ones than odd ones."""
    common = [(i, "the cat sat on the mat and the dog") for i in range(30)]
    docs = spark.createDataFrame([*common, (99, "mat the on sat cat the dog and the")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm_difference.scores(docs, docs.select("doc_id").limit(0)).collect()}
    assert len({rows[i]["background_loss"] for i in range(30)}) == 1
    assert rows[99]["background_loss"] > rows[0]["background_loss"]
