import pytest
from bolide.llm import icws_dedup, line_dedup
from bolide.llm.components import contract
from near_cases import classes, family

SCHEMA = "doc_id long, text string"


def test_family_matches_all_pairs(spark):
    rows = family()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in icws_dedup.near_duplicates(docs).collect()}
    assert got == classes(rows)


def test_one_of_each_class_stays_with_all_columns(spark):
    rows = family(seed=8, copies=15)
    docs = spark.createDataFrame([(i, t, i * 2, "x") for i, t in rows], SCHEMA + ", _row long, head string")
    kept = icws_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes(rows).values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert icws_dedup.near_duplicates(docs).count() == 0
    assert line_dedup.report(docs).count() == 0


def test_components_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (1, 0)]
    nodes = sorted({x for e in edges for x in e} | {500})
    labels = spark.createDataFrame([(n, n) for n in nodes], "node long, label long")
    out = {r["node"]: r["label"] for r in contract(labels, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({out[n] for n in range(61)}) == 1 and len({out[n] for n in range(100, 150)}) == 1
    assert len({out[0], out[100], out[500]}) == 3


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_match_all_pairs(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(70)]
    lines = [" ".join(base)]
    for _ in range(40):
        copy = list(base)
        copy[rng.randrange(70)] = word()
        lines.append(" ".join(copy).title())
    lines += [" ".join(word() for _ in range(9)) for _ in range(20)] + ["", "  a\tb ", "A b"]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(len(lines) // 3)] + [(90, None), (None, lines[0])]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.report(df).collect()}
    distinct = [(r["norm"], r["id"]) for r in _norms(spark, df)]
    prints = {
        r["id"]: r["simhash"]
        for r in line_dedup.fingerprints(spark.createDataFrame(distinct, "norm string, id long")).collect()
    }
    parent = {n: n for n, _ in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(distinct):
        for b, y in distinct[:i]:
            if bin((prints[x] ^ prints[y]) & (1 << 64) - 1).count("1") <= line_dedup.DISTANCE:
                if edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                    parent[find(a)] = find(b)
    seen, want = set(), {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        gone = []
        for pos, line in enumerate((text or "").split("\n")):
            norm = " ".join(line.lower().split())
            if norm and find(norm) in seen:
                gone.append(str(pos))
            elif norm:
                seen.add(find(norm))
        want[doc] = ",".join(gone)
    assert got == want
    assert any(want.values())
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_fuzzy_lines(df).collect()}
    for doc, text in docs:
        stay = [x for p, x in enumerate((text or "").split("\n")) if str(p) not in want[doc].split(",")]
        assert (left[doc] or "") == "\n".join(stay)


def test_edit_similarity_is_exact(spark):
    import random

    from pyspark.sql import functions as F

    rng, rows = random.Random(1), [("", "a"), ("é", "é é"), ("a b", "a b")]
    for _ in range(1500):
        a = [rng.choice(["a", "bb", "ccc", "dé"]) for _ in range(rng.randint(1, 9))]
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice([[], ["bb"], ["xx"]])
        rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    plain = F.levenshtein("a", "b") <= F.floor(F.greatest(F.length("a"), F.length("b")) * 0.2 + 1e-9)
    assert df.filter(~line_dedup.similar(F.col("a"), F.col("b")).eqNullSafe(plain)).count() == 0
    assert df.filter(plain & (F.col("a") != F.col("b"))).count() > 100


def _norms(spark, df):
    from pyspark.sql import functions as F

    lines = line_dedup._lines(df.select("text")).filter("norm <> ''")
    return lines.select("norm", F.xxhash64("norm").alias("id")).distinct().collect()


@pytest.mark.parametrize("lines", [10, 10**6, 10**9])
def test_blocks_find_every_pair_in_reach(spark, lines):
    import random

    from pyspark.sql import functions as F

    rng, m = random.Random(lines), line_dedup.blocks_for(lines)
    rows = []
    for i in range(100):
        x = rng.getrandbits(64) - (1 << 63)
        y = x
        for bit in rng.sample(range(64), 3):
            y ^= (1 << bit) if bit < 63 else -(1 << 63)
        rows.append((x, y))
    df = spark.createDataFrame(rows, "x long, y long")
    both = [line_dedup.block_keys(F.col(c), m) for c in ("x", "y")]
    assert df.filter(~F.arrays_overlap(*both)).count() == 0


def test_repeated_passages_match_all_pairs(spark):
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for times, length in [(40, 20), (25, 40), (200, 8)] * 5:
        passage = [word() for _ in range(length)] * times
        rows += [" ".join(passage + [word() for _ in range(60)]) for _ in range(2)]
    rows = list(enumerate(rows))
    want = classes(rows)
    assert len(set(want.values())) == 15
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["doc_id"]: r["class_id"] for r in icws_dedup.near_duplicates(docs).collect()} == want


def test_very_long_lines_are_matched(spark):
    words = [f"w{i}" for i in range(1 << 15)]
    near = words[:-1] + ["changed"]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::2]))], SCHEMA)
    assert {r["doc_id"]: r["dropped_lines"] for r in line_dedup.report(df).collect()} == {1: "", 2: "0", 3: ""}


def test_lines_of_like_spelling_are_found(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    pairs = []
    for length, changed in [(8, 1), (15, 1), (30, 1), (30, 3), (60, 6)] * 30:
        a = [word() for _ in range(length)]
        b = list(a)
        for at in rng.sample(range(length), changed):
            b[at] = word()
        pairs.append((" ".join(a), " ".join(b)))
    pairs += [("http://" + x + "/1", "http://" + x + "/2") for x in ("".join(word() for _ in range(8)) for _ in range(30))]
    like = [
        2 * n + 1 for n, (a, b) in enumerate(pairs) if edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
    ]
    assert len(like) > 150
    df = spark.createDataFrame([x for n, (a, b) in enumerate(pairs) for x in ((2 * n, a), (2 * n + 1, b))], SCHEMA)
    found = {r["doc_id"] for r in line_dedup.report(df).filter("n_kept = 0").collect()}
    assert found <= set(like)
    assert len(found) >= 0.97 * len(like), (len(found), len(like))
