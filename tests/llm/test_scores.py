import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from bolide.llm import lm_difference, quality_mil, toxicity_fst

ODD = [(1, "A  b\n"), (1, "A  b\n"), (2, "one two three"), (3, None), (4, ""), (None, "a b"), (5, "w " * 9000)]
SCHEMA = "doc_id long, text string, source string, _row long, score double"
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (99, 0, 0), (None, 1, 1), (5, None, None)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "s", 7, 9.0) for i, t in ODD], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator", [quality_mil, toxicity_fst])
def test_scores_of_odd_rows(odd, labels, operator):
    for known in (labels, labels.limit(0)):
        rows = operator.predictions(odd, known).collect()
        assert len(rows) == len(ODD)
        for r in rows:
            name = "" if r["doc_id"] is None else str(r["doc_id"])
            assert r["held_out"] == (zlib.crc32(name.encode()) % 5 == 0)
            assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= operator.THRESHOLD)
        assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert operator.predictions(odd.limit(0), labels).count() == 0


def test_differences_of_odd_rows(odd, labels):
    rows = lm_difference.scores(odd, labels.filter("quality = 1")).collect()
    assert len(rows) == len(ODD)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 5} == {9001}
    for r in rows:
        assert abs(r["score"] - (r["target_loss"] - r["background_loss"])) < 1e-9
    assert lm_difference.scores(odd.limit(0), labels).count() == 0


def plain_differences(rows, targets, bigram=0.6, added=0.1):
    """(tokens, target loss, background loss) of each row, counted in dicts."""
    texts = [["<", *re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()), ">"] for _, t in rows]
    words, pairs = [Counter(t) for t in texts], [Counter(zip(t, t[1:])) for t in texts]
    good = [i for i, (d, _) in enumerate(rows) if d in targets]
    vocabulary = max(1, len(set().union(*words)) - 1)
    out = []
    for i, t in enumerate(texts):
        found = [len(t) - 1]
        for model in ([j for j in good if j != i], range(len(rows))):
            of_word, of_pair = Counter(), Counter()
            for j in model:
                of_word.update(words[j])
                of_pair.update(pairs[j])
            total = sum(of_word.values()) - of_word["<"]
            loss = 0
            for before, word in zip(t, t[1:]):
                unigram = (of_word[word] + added) / (total + added * vocabulary)
                share = bigram if of_word[before] else 0
                chance = share * of_pair[before, word] / max(1, of_word[before]) + (1 - share) * unigram
                loss -= math.log(chance)
            found.append(loss / (len(t) - 1))
        out.append(tuple(found))
    return out


@pytest.mark.parametrize("run, piece, most", [(16 << 20, 4 << 20, 9), (400, 90, 1)])
def test_differences_match_plain_counts(spark, monkeypatch, run, piece, most):
    rng = random.Random(5)
    vocabulary = ["the", "The", "cat", "dog", "sat", "\u00e9t\u00e9", "x1", "on", "mat"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(60)]
    rows += [rows[3], rows[3], (70, None), (71, ""), (72, "long " * 500), (None, "the cat")]
    targets = {3, 5, 8, 13, 72, 99}
    monkeypatch.setattr(lm_difference, "RUN_BYTES", run)
    marked, parts = lm_difference.marked, lm_difference.parts_of
    monkeypatch.setattr(lm_difference, "marked", lambda docs, ids: marked(docs, ids, most))
    monkeypatch.setattr(lm_difference, "parts_of", lambda sizes, text: parts(sizes, text, piece))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(t,) for t in [*targets, 3, None]], "doc_id long")
    got = sorted(tuple(r)[1:4] for r in lm_difference.scores(docs, ids).collect())
    for a, b in zip(got, sorted(plain_differences(rows, targets)), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize(
    "text, want",
    [
        ("I will kill you", ["threat vowed, plain, direct"]),
        ("Kill them all!", ["threat object, plain, direct"]),
        ("you kill time", ["threat bare, plain, direct"]),
        ("I will not hurt you", ["threat object, negated, direct"]),
        ("I do not mind you but you are an idiot", ["insult, said, plain, direct"]),
        ("You are not an idiot", ["insult, said, negated, direct"]),
        ("I don't think that you are an idiot", ["insult, said, negated, direct"]),
        ("you are not clever, you fool", ["insult, called, plain, direct"]),
        ("an idiot like you", ["insult, called, plain, direct"]),
        ("the film has a clown. You saw it", ["insult, bare, plain, direct"]),
        ("he said that you are an idiot", ["insult, said, plain, reported"]),
        ("he said hello but you are an idiot", ["insult, said, plain, direct"]),
        ("\u201cyou are an idiot\u201d, she said", ["insult, said, plain, reported"]),
        ('the "book" fell, you fool', ["insult, called, plain, direct"]),
        ("w " * 5000 + "you idiot", ["insult, called, plain, direct"]),
        ("", []),
    ],
)
def test_clauses_are_read_by_the_grammar(text, want):
    assert toxicity_fst.matches(text) == want


def all_readings(kinds, weights, states=(0,) * len(toxicity_fst.PARTS)):
    """Weight and marks of every accepted way of the transducers side by side."""
    if not kinds:
        if all(s in p.accepting for s, p in zip(states, toxicity_fst.PARTS)):
            yield 0.0, ()
        return
    ways = [()]
    for part, state in zip(toxicity_fst.PARTS, states):
        ways = [(*w, a) for w in ways for a in part.arcs(state, kinds[0])]
    for way in ways:
        here = weights[0] * math.prod(a.factor for a in way) + sum(a.bonus for a in way)
        mark = ", ".join(a.mark for a in way if a.mark)
        for weight, marks in all_readings(kinds[1:], weights[1:], tuple(a.to for a in way)):
            yield here + weight, ((mark, *marks) if kinds[0] in toxicity_fst.MATCHES else marks)


def test_composition_takes_the_heaviest_of_all_paths():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 9, 400)
    kind = rng.integers(0, len(toxicity_fst.CLASSES), size.sum())
    weight = np.where(np.isin(kind, toxicity_fst.MATCHES), rng.uniform(1, 6, len(kind)), 0)
    path = toxicity_fst.GRAMMAR.read(kind, weight, size)
    assert ((path >= 0) == np.isin(kind, toxicity_fst.MATCHES)).all()
    for end, n in zip(np.cumsum(size), size):
        part = slice(end - n, end)
        found = tuple(toxicity_fst.GRAMMAR.names[p] for p in path[part] if p >= 0)
        readings = list(all_readings(kind[part].tolist(), weight[part].tolist()))
        best = max(w for w, _ in readings)
        assert found in {marks for w, marks in readings if w > best - 1e-9}
