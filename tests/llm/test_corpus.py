import random
import zlib

import numpy as np
import pytest
from bolide.llm import exact_dedup, huffman_ids, packing, phrase_index, shard_tree

ODD = [(1, "A  b\n"), (1, "A  b\n"), (2, "a b"), (3, None), (4, ""), (None, "A b "), (5, "A\tb "), (6, "x" * 5000)]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "s", 7, 8) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _row long, digest long")


@pytest.mark.parametrize("share", [2, 1024])
def test_exact_groups(odd, share):
    got = exact_dedup.exact_groups(odd, share=share, tracked=2048).collect()
    assert len(got) == len(ODD)
    assert {r["keep_id"] for r in got if r["doc_id"] in (1, 5, None)} == {1}
    assert sum(r["kept"] for r in got) == 4
    assert {r["group_size"] for r in got if r["doc_id"] in (3, 4)} == {2}
    kept = exact_dedup.drop_copies(odd, share=share, tracked=2048)
    assert kept.columns == odd.columns and kept.count() == 4


def test_canonical_codes_decode_in_blocks():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 20_000), 3000)
    found, n = np.unique(ids, return_counts=True)
    lengths = huffman_ids.code_lengths(dict(zip(found.tolist(), n.tolist())))
    assert max(lengths.values()) <= huffman_ids.MAX_BITS
    assert sum(2.0**-b for b in lengths.values()) == 1
    book = huffman_ids.Codebook(lengths)
    for size in (0, 1, 255, 256, 257, 20_000):
        assert (book.decode(*book.encode(ids[:size]), size) == ids[:size]).all()


def test_shards_grow_into_the_new_one_only(spark, odd):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = shard_tree.assign(docs, shard_tree.default_tree(16), shard_tree.default_tree(17)).collect()
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {16}
    for shard in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(
            range(sum(r["shard"] == shard for r in rows))
        )
    assert all(r["text_crc32"] == zlib.crc32(str(r["doc_id"]).encode()) for r in rows)
    assert shard_tree.assign(odd, shard_tree.default_tree(16)).count() == len(ODD)


def test_best_fit_is_the_tightest_compatible():
    rng = random.Random(2)
    items = [(rng.randint(1, 99), rng.choice("aab"), rng.randint(0, 40)) for _ in range(300)]
    got = packing.best_fit(items, 100)
    bins = []
    for (need, source, cluster), (b, start) in zip(items, got):
        fits = [
            (100 - sum(i[0] for i in held), k)
            for k, held in enumerate(bins)
            if 100 - sum(i[0] for i in held) >= need
            and all(i[1] != source and i[2] != cluster for i in held)
        ]
        if fits:
            assert 100 - sum(i[0] for i in bins[b]) == min(fits)[0]
        else:
            assert b == len(bins)
            bins.append([])
        assert start == sum(i[0] for i in bins[b])
        bins[b].append((need, source, cluster))


def test_pieces_cover_long_texts(spark, odd):
    docs = spark.createDataFrame([(1, "w " * 5000, None), (2, "", "s")], "doc_id long, text string, source string")
    rows = packing.pack(docs, capacity=2048).collect()
    assert sum(r["n_words"] for r in rows) == 5000
    assert [r["bin"] for r in rows if r["doc_id"] == 2] == [None]


def test_phrases_and_proximity(spark, odd):
    bench = spark.createDataFrame([("q", "one two three four"), ("z", "A b"), (None, None)], "item_id string, text string")
    docs = spark.createDataFrame(
        [(1, "x ONE two, three four y"), (2, "one two and three four"), (3, None), (4, "four")], "doc_id long, text string"
    )
    got = {r["doc_id"]: r for r in phrase_index.report(docs, bench).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["n_words"]) == (4, 1, 6)
    assert not got[2]["contaminated"] and got[2]["n_near_items"] == 1
    assert got[3]["n_words"] == 0 and not got[4]["contaminated"]
    left = phrase_index.drop_contaminated(odd, bench)
    assert left.columns == odd.columns and left.count() == 3
    assert phrase_index.report(docs, bench.limit(0)).filter("contaminated").count() == 0
