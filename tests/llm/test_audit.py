"""Host rules, source divergence and token alignment against plain Python, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from bolide.llm import divergence, host_rules, token_alignment

SCHEMA = "doc_id long, text string, lang string, source string, _row long, _host string, term string, part int"
ODD = [
    (1, "A  b\n", "en", "s"),
    (1, "A  b\n", "en", "s"),
    (2, None, None, None),
    (3, "", "", ""),
    (None, "one two three\n\none two three", "en", None),
    (4, "w " * 3000, "en", "t"),
    (5, "#$%& |<>*\n" * 9, "fr", "s"),
    (6, "\x0b\x1c x\x00y é z ÉÀ", "fr", "t"),
    (7, "x" * 30_000, "fr", "t"),
]
WORDS = "the of and Über été naïve x y z the the".split()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "h", "t", 8) for r in ODD], SCHEMA)


def prose(rng, n, words):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, t, lang, source) for i, (_, t, lang, source) in enumerate(ODD)]
    for i in range(len(ODD), 90):
        words = WORDS + [f"{chr(97 + rng.randrange(9))}{chr(97 + k % 26)}" for k in range(rng.choice([0, 40, 300]))]
        junk = rng.random() < 0.2
        text = prose(rng, rng.choice([0, 3, 60, 400]), words) + ("*** $$$ " * 60 if junk else "")
        out.append((i, text, rng.choice(["en", "fr"]), f"s{rng.randrange(5)}"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    signs = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), signs, len(lines) - len(set(lines)), len(inside), len(lines)


COUNTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@pytest.mark.parametrize("long_bytes", [host_rules.LONG_BYTES, 40])
def test_counts_of_documents(docs, rows, long_bytes):
    got = {r["doc_id"]: tuple(r[c] for c in COUNTED) for r in host_rules.counts(docs, long_bytes=long_bytes).collect()}
    assert got == {i: plain_counts(text) for i, text, _, _ in rows}


def plain_verdicts(rows):
    """Per host: rejected, and the rules whose failures go."""
    failed = defaultdict(list)
    for _, text, _, source in rows:
        words, chars, signs, dup, repeats, lines = plain_counts(text)
        failed[source or ""].append(
            {
                "repeats": 100 * repeats > 50 * words,
                "symbols": 10 * signs > words,
                "word_length": chars < 3 * words or chars > 12 * words,
                "dup_lines": 2 * dup > lines,
            }
        )
    rates = defaultdict(dict)
    for rule in host_rules.RULES:
        f = {h: sum(x[rule] for x in xs) for h, xs in failed.items()}
        n = {h: len(xs) for h, xs in failed.items()}
        total, hit, k = sum(n.values()), sum(f.values()), len(n)
        a = b = 0.0
        if k > 1 and 0 < hit < total:
            mean = hit / total
            spread = sum(f[h] ** 2 / n[h] for h in n) - hit**2 / total - (k - 1) * mean * (1 - mean)
            rho = spread / ((total - sum(x * x for x in n.values()) / total - (k - 1)) * mean * (1 - mean))
            strength = 1 / min(1.0, max(1e-6, rho)) - 1
            a, b = mean * strength, (1 - mean) * strength
        for h in n:
            rates[h][rule] = (f[h] + a) / (n[h] + a + b)
    return rates


@pytest.mark.parametrize("broadcast", [host_rules.BROADCAST_HOSTS, 0])
def test_host_verdicts(docs, rows, broadcast, monkeypatch):
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", broadcast)
    rates = plain_verdicts(rows)
    table = host_rules.counts(docs)
    for r in host_rules.host_rates(table).collect():
        for rule in host_rules.RULES:
            assert r[f"r_{rule}"] == pytest.approx(rates[r["_host"]][rule], abs=1e-9)
    for reject, suspect in ((0.5, 0.01), (0.2, 0.05), (2.0, 2.0)):
        got = {r["doc_id"]: r for r in host_rules.judged(table, reject=reject, suspect=suspect).collect()}
        assert len(got) == len(rows)
        for i, text, _, source in rows:
            words, chars, signs, dup, repeats, lines = plain_counts(text)
            hit = {
                "repeats": 100 * repeats > 50 * words,
                "symbols": 10 * signs > words,
                "word_length": chars < 3 * words or chars > 12 * words,
                "dup_lines": 2 * dup > lines,
            }
            rate = rates[source or ""]
            base = words < 50 or hit["repeats"]
            gone = max(rate.values()) >= reject
            suspects = [r for r in host_rules.RULES if hit[r] and rate[r] >= suspect]
            assert (got[i]["base_failed"], got[i]["host_rejected"]) == (base, gone)
            assert got[i]["suspect_rules"] == ",".join(suspects)
            assert got[i]["kept"] == (not base and not gone and not suspects)


def test_host_rules_on_odd_rows(odd):
    assert host_rules.report(odd).count() == len(ODD)
    assert host_rules.report(odd.limit(0)).count() == 0
    kept = host_rules.keep_sound(odd)
    assert kept.columns == odd.columns and kept.count() == 0
    sound = odd.sparkSession.createDataFrame(
        [(i, " ".join(f"word{k}" for k in range(60)), "h") for i in (1, 1, 2)], "doc_id long, text string, site string"
    )
    assert host_rules.keep_sound(sound, "site").count() == 3


def plain_audit(rows, min_docs, top):
    tokens = [
        (lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text or "")))
        for _, text, lang, source in rows
    ]
    docs_of = defaultdict(Counter)
    for lang, _, words in tokens:
        docs_of[lang].update(set(words))
    out = set()
    for lang in {t[0] for t in tokens}:
        kept = {w for w, n in docs_of[lang].items() if n >= min_docs}
        groups = defaultdict(Counter)
        for other, source, words in tokens:
            if other == lang:
                groups[source].update(w for w in words if w in kept)
        rate = lambda n, total: 1 + 1_000_000_000 * (n + 1) // (total + len(kept))
        whole = sum(groups.values(), Counter())
        p = {s: {w: rate(c[w], sum(c.values())) for w in kept} for s, c in groups.items()}
        q = {w: rate(whole[w], sum(whole.values())) for w in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in groups:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in groups if o != s]
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(sorted(pairs))}
            over = [(-f(p[s][w], q[w]), w.encode()) for w in kept if groups[s][w] and p[s][w] > q[w]]
            out |= {(lang, s, "term", w.decode(), -v, k + 1) for k, (v, w) in enumerate(sorted(over)[:top])}
    return out


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize(("bits", "top", "stripe"), [(64, 200, 256), (3, 5, 2)])
def test_divergence(docs, rows, bits, top, stripe, monkeypatch):
    monkeypatch.setattr(divergence, "STRIPE", stripe)
    if stripe < 256:
        monkeypatch.setattr(divergence, "PIECE_TERMS", (4, 16))
    got = divergence.audit(docs, top=top, bits=bits).select("lang", "source", "part", "item", "value", "rank").collect()
    want = plain_audit(rows, 3, top)
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_divergence_of_odd_rows(odd):
    got = divergence.audit(odd).collect()
    assert {(r["lang"], r["source"]) for r in got} == {("en", ""), ("en", "s"), ("en", "t"), ("fr", "s"), ("fr", "t")}
    assert {r["value"] for r in got if r["lang"] == "fr"} == {0}
    assert divergence.audit(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts, paths):
    pair = token_alignment.Tokenizers(*paths)
    found = []
    for text in texts:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if any(b"".join(s[i] for i in ids) != whole for s, ids in ((pair.a_bytes, a), (pair.b_bytes, b))):
            a = b = []
        ends = []
        for ids, spelled in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, own = 0, []
            for i in ids:
                at += len(spelled[i])
                own.append(at)
            ends.append(own)
        links, groups, i, j = Counter(), [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            left, right = [], []
            while i < len(a) and ends[0][i] <= cut:
                left.append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= cut:
                right.append(b[j])
                j += 1
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            links.update((x, y) for x in left for y in right)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((len(a), len(b), len(groups), links, digest))
    count = Counter(k for f in found for k in f[3])
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [
        (
            *f[:3],
            sum(f[3].values()),
            sum(n for k, n in f[3].items() if count[k] == top[k[0]]),
            sum(n * count[k] for k, n in f[3].items()),
            f[4],
        )
        for f in found
    ]


def odd_texts(n):
    rng = random.Random(3)
    bits = ["a", "The", "é", " ", "  ", "\n", "\t", " ", "▁", "　", "日本", "1", "345", "'s", "<s>"]
    bits += ["<|endoftext|>", "#", "***", "\x00", "\x7f", "​", "🙂", "x" * 7, "\r", " ", "①", "word", "ing"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*texts, None, "", " ", "  ", "a ", "日本" * 900, "12345" * 900, "z" * 40_000, "a b", "a b"]


@pytest.mark.parametrize("chunk_bytes", [token_alignment.CHUNK_BYTES, 500])
def test_alignment(spark, paths, chunk_bytes, monkeypatch):
    texts = odd_texts(300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_alignment.report(docs, *paths, chunk_bytes).collect()}
    want = plain_alignment(texts, paths)
    assert got == dict(enumerate(want))
    assert sum(w[0] > 0 for w in want) > 100


def test_stretches_and_wide_parts_change_nothing(paths, monkeypatch):
    import pyarrow as pa

    pair, column = token_alignment.Tokenizers(*paths), pa.array(odd_texts(200), pa.string())
    whole = token_alignment.Run(column, pair)
    want = [x.tolist() for x in token_alignment._summed(whole.links())]
    monkeypatch.setattr(token_alignment, "WIDE", 50)
    for stretch in (1, 3, 10**9):
        run = token_alignment.Run(column, pair, stretch)
        assert [x.tolist() for x in token_alignment._summed(run.links())] == want
        assert (run.cut_a == whole.cut_a).all() and (run.cut_b == whole.cut_b).all()


def test_forgotten_words_come_again(paths, monkeypatch):
    import pyarrow as pa

    pair = token_alignment.Tokenizers(*paths)
    texts = odd_texts(100)
    decimals = token_alignment._decimals(51_000)
    want = token_alignment.Run(pa.array(texts, pa.string()), pair).hashes(decimals)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 40)
    got = [token_alignment.Run(pa.array([t], pa.string()), pair).hashes(decimals)[0] for t in texts]
    assert got == want


def test_alignment_of_odd_rows(odd, paths):
    rows = token_alignment.report(odd, *paths).collect()
    assert len(rows) == len(ODD)
    assert {(r["n_a"], r["groups_sha256"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, "")}
    assert token_alignment.report(odd.limit(0), *paths).count() == 0
