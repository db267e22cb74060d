"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns words, commas and quotation marks into classes. Five small transducers
read the classes of a clause, each for one phenomenon: ``insult`` and ``threat`` (bare, with an
object, or vowed by a modal), ``target`` (an insult said of somebody, called after somebody, or bare),
``negation`` (within a scope that words use up and a turn of the sentence ends) and ``report``
(reported speech after its verb, or in quotation marks before or after it). Arcs carry a mark and
a weight; where what comes later decides, a transducer has several arcs and those
that guess wrong end nowhere. ``compose`` makes one machine of them, and of all its
paths through a clause the heaviest counts. The lexicon's weights of the matches on it are summed by
their marks ("insult, said of somebody, not negated, not reported"), and a logistic unit
weighs these sums: so a word alone decides nothing, its clause does.

Insults are the seed words and the words and stems (``word*``) that labelled
documents show to be toxic; these are learned from one half of a bounded sample
(``TRAIN_ROWS``, ``TRAIN_BYTES``), the weights of the sums from the other half. All spellings of the sample's
distinct texts are candidates; those learned are as many, by their log-likelihood ratio, as leave an expected share of ``CHANCE``
that are toxic by chance (Benjamini and Hochberg's rule). Documents are scored where they are read.

Defined cases: a null or empty text matches nothing and gets the score of no match. Without
labels of both kinds the seed lexicon and ``PRIOR`` weights hold. Empty
tables give no rows; repeated doc_ids are scored each. A clause ends at ``CLAUSE_END`` or
after ``CLAUSE_WORDS`` words and marks, where the next one begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bolide.llm.shared import Words, held_out, labelled_sample, pieces, send
from bolide.plans.settle import settle

TRAIN_ROWS = 20_000
TRAIN_BYTES = 64 << 20
THRESHOLD = 0.5
STEM_BYTES = [4, 5, 6, 7, 8]
SEED_WEIGHT = 3.0
CHANCE = 0.1
CLAUSE_WORDS = 100
# Words read at a time: bounds the table of choices.
BATCH_WORDS = 1 << 15

INSULT, THREAT, TARGET, NEGATION, REPORT, COPULA, MODAL, FILLER, TURN, COMMA, QUOTE, OTHER = CLASSES = range(12)
MATCHES = (INSULT, THREAT)
SEEDS = {
    INSULT: "idiot moron stupid dumb scum trash loser pathetic worthless disgusting clown fool "
    "imbecile vermin filth coward ugly",
    THREAT: "kill hurt destroy crush beat stab shoot burn hang punish",
    TARGET: "you your yours yourself he him his she her they them their these those u ur",
    NEGATION: "not no never neither nor without isn aren wasn weren don doesn didn won",
    REPORT: "said says say wrote writes claimed claims called calls reported reports quoted quote told "
    "alleged according",
    COPULA: "am are is was were be been being re",
    MODAL: "will shall would should must can could may might ll gonna going wanna want",
    FILLER: "a an the such so very really just total totally complete completely utter utterly absolute "
    "all of both every each to that like personally t",
    TURN: "but however although though because while whereas and or yet",
}
# A clause ends at these bytes.
CLAUSE_END = np.isin(np.arange(256), [ord(c) for c in ".!?;\n"])
CURLY = {"\u201c": '"', "\u201d": '"', "\u00ab": '"', "\u00bb": '"', "\u2019": "'"}
SCOPE = 4


@dataclass(frozen=True)
class Arc:
    """To a state, with a mark for the match read, what multiplies its weight, and a weight of its own."""

    to: int
    mark: str = ""
    factor: float = 1.0
    bonus: float = 0.0


@dataclass(frozen=True)
class Transducer:
    """``arcs(state, class)`` from state 0 on; a clause may end in the ``accepting`` states."""

    arcs: Callable[[int, int], list[Arc]]
    accepting: tuple[int, ...]


def _insult(state: int, read: int) -> list[Arc]:
    return [Arc(0, "insult" if read == INSULT else "")]


def _threat(state: int, read: int) -> list[Arc]:
    """States: none, after a modal, before the object."""
    if state == 2:
        return [Arc(0)] if read == TARGET else [Arc(2)] if read == FILLER else []
    if read == THREAT:
        return [Arc(0, "threat bare", 0.5), Arc(2, "threat vowed", 2.0) if state else Arc(2, "threat object", 1.5)]
    return [Arc(1 if read == MODAL or state and read == FILLER else 0)]


def _target(state: int, read: int) -> list[Arc]:
    """States: none, after a target, after what is said of it begins, before the target of an insult."""
    if state == 3:
        return [Arc(1)] if read == TARGET else [Arc(3)] if read == FILLER else []
    if read == TARGET:
        return [Arc(1)]
    if read == INSULT:
        own = [Arc(0, "bare"), Arc(1, "called", 1.5), Arc(2, "said", 2.0)][state]
        return [own] if state else [own, Arc(3, "called", 1.5)]
    if state and read in (COPULA, NEGATION):
        return [Arc(2)]
    return [Arc(state if read == FILLER or state == 1 and read == COMMA else 0)]


def _negation(state: int, read: int) -> list[Arc]:
    """States: how many words the scope still reaches."""
    to = {NEGATION: SCOPE, TURN: 0, COMMA: 0, FILLER: state, QUOTE: state}.get(read, max(0, state - 1))
    if read not in MATCHES:
        return [Arc(to)]
    return [Arc(to, "negated", 0.2) if state else Arc(to, "plain")]


def _report(state: int, read: int) -> list[Arc]:
    """States: direct, after a verb, its quotation, a quotation whose verb comes later, after that quotation."""
    if read in MATCHES:
        return [] if state == 4 else [Arc(state, "reported", 0.3) if state else Arc(0, "direct")]
    if state == 0:
        return [Arc(0), Arc(3)] if read == QUOTE else [Arc(1 if read == REPORT else 0)]
    if state == 1:
        return [Arc({QUOTE: 2, TURN: 0}.get(read, 1))]
    if read == QUOTE:
        return {2: [Arc(0)], 3: [Arc(4)], 4: []}[state]
    if state == 4:
        # Such a reading is right wherever it is possible.
        return [Arc(1, bonus=1000.0)] if read == REPORT else [Arc(4)] if read in (COMMA, TARGET, FILLER, OTHER) else []
    return [Arc(state)]


PARTS = [
    Transducer(_insult, (0,)),
    Transducer(_threat, (0, 1)),
    Transducer(_target, (0, 1, 2)),
    Transducer(_negation, tuple(range(SCOPE + 1))),
    Transducer(_report, (0, 1, 2)),
]


@dataclass
class Grammar:
    """The composition: per class, tables of states x arcs (``to`` the number of states: no arc; ``path`` -1: no match)."""

    to: list[np.ndarray]
    factor: list[np.ndarray]
    bonus: list[np.ndarray]
    path: list[np.ndarray]
    accepting: np.ndarray
    names: list[str]

    def read(self, kind: np.ndarray, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The path of each match on the heaviest way through each clause, -1 elsewhere; ``size`` of the clauses in order."""
        path = np.full(len(kind), -1)
        first = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        total = np.cumsum(size[order])
        i = 0
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BATCH_WORDS, "right")))
            self._best(kind, weight, first[order[i:j]], size[order[i:j]], path)
            i = j
        return path

    def _best(
        self, kind: np.ndarray, weight: np.ndarray, first: np.ndarray, size: np.ndarray, path: np.ndarray
    ) -> None:
        states = len(self.accepting)
        # From the end: the weight of the best way on from each state, and the arc that it takes.
        onward = np.full((len(size), states + 1), -np.inf)
        onward[:, :states][:, self.accepting] = 0
        row = np.cumsum(size) - size
        choice = np.zeros((int(size.sum()), states), np.uint8)
        for back in range(int(size[0])):
            n = int(np.searchsorted(-size, -back, "left"))  # clauses longer than ``back``
            at = size[:n] - 1 - back
            word = first[:n] + at
            for k in np.unique(kind[word]):
                of = np.flatnonzero(kind[word] == k)
                ways = onward[of][:, self.to[k]] + self.bonus[k] + self.factor[k] * weight[word[of], None, None]
                best = ways.argmax(2)
                choice[(row[:n] + at)[of]] = best
                onward[of, :states] = np.take_along_axis(ways, best[:, :, None], 2)[:, :, 0]
        state = np.zeros(len(size), np.int64)
        for step in range(int(size[0])):
            n = int(np.searchsorted(-size, -step, "left"))
            word, taken = first[:n] + step, choice[row[:n] + step, state[:n]]
            for k in np.unique(kind[word]):
                of = np.flatnonzero(kind[word] == k)
                path[word[of]] = self.path[k][state[of], taken[of]]
                state[of] = self.to[k][state[of], taken[of]]


def compose(parts: list[Transducer]) -> Grammar:
    """All reachable combinations of the parts' states; an arc for each combination of their arcs."""
    number = {(0,) * len(parts): 0}
    found: list[list[list[tuple[int, float, float, int]]]] = []
    names: list[str] = []
    states = list(number)
    for state in states:  # grows while it is read
        found.append([])
        for read in CLASSES:
            arcs = []
            for way in product(*[p.arcs(x, read) for p, x in zip(parts, state)]):
                to = tuple(a.to for a in way)
                if to not in number:
                    number[to] = len(states)
                    states.append(to)
                path = -1
                if read in MATCHES:
                    name = ", ".join(a.mark for a in way if a.mark)
                    if name not in names:
                        names.append(name)
                    path = names.index(name)
                factor = float(np.prod([a.factor for a in way]))
                arcs.append((number[to], factor, sum(a.bonus for a in way), path))
            found[-1].append(arcs)
    tables = []
    for read in CLASSES:
        width = max(1, *(len(f[read]) for f in found))
        none = (len(states), 0.0, 0.0, -1)
        full = [f[read] + [none] * (width - len(f[read])) for f in found]
        tables.append([np.array([[arc[c] for arc in row] for row in full]) for c in range(4)])
    accepting = np.array([all(x in p.accepting for x, p in zip(s, parts)) for s in states])
    to, factor, bonus, path = (list(t) for t in zip(*tables))
    return Grammar(to, factor, bonus, path, accepting, names)


GRAMMAR = compose(PARTS)
MANNERS = {"threat bare": 0.3, "threat object": 2.0, "threat vowed": 2.5, "insult, bare": 1.5}


def _prior(name: str) -> float:
    manner = next((w for m, w in MANNERS.items() if name.startswith(m)), 2.0)
    return manner * (0.2 if "negated" in name else 1) * (0.3 if "reported" in name else 1)


# Weights before anything is learned: by path, then of the clauses, then bias.
PRIOR = np.array([*map(_prior, GRAMMAR.names), 0.0, 0.0, 0.0, -3.0])


@dataclass
class Lexicon:
    """Word or stem -> class and weight, as sorted hashes per stem length (None: whole words)."""

    entries: dict[str, tuple[int, float]] = field(default_factory=dict)  # a stem ends with *

    def __post_init__(self):
        self.tables = {}
        by_size: dict[int | None, list[tuple[bytes, int, float]]] = {}
        for spelling, (kind, weight) in self.entries.items():
            stem = spelling.endswith("*")
            raw = spelling.rstrip("*").encode("utf-8", "surrogateescape")
            by_size.setdefault(len(raw) if stem else None, []).append((raw, kind, weight))
        for size, rows in by_size.items():
            h = Words(pa.array([r[0] for r in rows], pa.binary())).hashes()
            order = np.argsort(h)
            kinds, weights = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            self.tables[size] = (h[order], kinds[order], weights[order])

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The class of every word (-1: none) and its weight; whole words before longer before shorter stems."""
        kind, weight = np.full(len(words), -1), np.zeros(len(words))
        # What is read later overrides: longer stems, then whole words.
        sizes = sorted(self.tables, key=lambda s: (s is None, s or 0))
        for size, h in zip(sizes, words.hashed(sizes)):
            table, kinds, weights = self.tables[size]
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = np.flatnonzero(table[at] == h)
            kind[hit], weight[hit] = kinds[at[hit]], weights[at[hit]]
        return kind, weight


def seed_lexicon() -> Lexicon:
    return Lexicon(
        {w: (k, SEED_WEIGHT if k in MATCHES else 0.0) for k, ws in SEEDS.items() for w in ws.split()}
    )


FEATURES = len(GRAMMAR.names) + 4


def _read(column: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text; document, weight and path of each match; documents of clauses with a match."""
    for curly, plain in CURLY.items():
        column = pc.replace_substring(column, curly, plain)
    words = Words(column)
    kind, weight = lexicon.read(words)
    kind[kind < 0] = OTHER
    signs = np.flatnonzero((words.raw == ord(",")) | (words.raw == ord('"')))
    sign = np.where(words.raw[signs] == ord(","), COMMA, QUOTE)
    cuts = np.sort(np.concatenate([np.flatnonzero(CLAUSE_END[words.raw]) + 1, words.offsets[1:-1]]))
    # Only clauses with something to match need a run of the grammar.
    live = np.zeros(len(cuts) + 1, bool)
    clause, of_sign = (np.searchsorted(cuts, x, "right") for x in (words.start, signs))
    live[clause[np.isin(kind, MATCHES)]] = True
    in_word, in_sign = live[clause], live[of_sign]
    place = np.concatenate([words.start[in_word], signs[in_sign]])
    order = np.argsort(place, kind="stable")
    doc = np.searchsorted(words.offsets, place[order], "right") - 1
    kind = np.concatenate([kind[in_word], sign[in_sign]])[order]
    weight = np.concatenate([weight[in_word], np.zeros(in_sign.sum())])[order]
    clause = np.concatenate([clause[in_word], of_sign[in_sign]])[order]
    weight[~np.isin(kind, MATCHES)] = 0
    edge = np.ones(len(clause), bool)
    edge[1:] = clause[1:] != clause[:-1]
    begin = np.flatnonzero(edge)
    rank = np.arange(len(clause)) - np.repeat(begin, np.diff(np.append(begin, len(clause))))
    begin = np.flatnonzero(rank % CLAUSE_WORDS == 0)
    size = np.diff(np.append(begin, len(clause)))
    matched = np.add.reduceat(np.isin(kind, MATCHES), begin) > 0 if len(begin) else np.zeros(0, bool)
    kept = np.repeat(matched, size)
    doc, kind, weight = doc[kept], kind[kept], weight[kept]
    size = size[matched]
    path = GRAMMAR.read(kind, weight, size)
    hit = path >= 0
    return words.per_doc, doc[hit], weight[hit], path[hit], doc[np.cumsum(size) - size]


def matches(text: str, lexicon: Lexicon | None = None) -> list[str]:
    """The marks of the matches in one text, in order."""
    path = _read(pa.array([text], pa.string()), lexicon or seed_lexicon())[3]
    return [GRAMMAR.names[p] for p in path]


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: weight matched on each path (log), matches a word, matched clauses, length where any, and 1."""
    per_doc, doc, weight, path, clauses = _read(column, lexicon)
    n, paths = len(per_doc), len(GRAMMAR.names)
    sums = np.bincount(doc * paths + path, weight, n * paths).reshape(n, paths)
    total = sums.sum(1)
    return np.column_stack(
        [
            np.log1p(sums),
            np.log1p(100 * total / np.maximum(per_doc, 1)),
            np.log1p(np.bincount(clauses, minlength=n)),
            np.log1p(per_doc) * (total > 0),
            np.ones(n),
        ]
    )


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        x = features(column, self.lexicon) @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps, held near ``PRIOR``."""
    if len(set(y.tolist())) < 2:
        return PRIOR
    w, near = PRIOR.copy(), np.full(len(PRIOR), ridge)
    near[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + near * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(near)
        move = np.linalg.solve(curve, slope)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Seeds, and the words and stems much more frequent in toxic than in clean documents."""
    # Copies say nothing more about their words than one of them.
    sample = sample.groupBy("text").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return seed_lexicon()

    def spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part["text"])
                doc = words.doc().astype(np.uint64)
                low = words.low.tobytes()
                for size, h in zip([None, *STEM_BYTES], words.hashed([None, *STEM_BYTES])):
                    # Once per document, then per spelling the number of documents.
                    pair = np.flatnonzero(h)
                    order = pair[np.lexsort((doc[pair], h[pair]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                    order = order[new]
                    found, at, n = np.unique(h[order], return_index=True, return_counts=True)
                    s = words.start[order[at]]
                    e = words.end[order[at]] if size is None else s + size
                    spelled = [low[a:b] for a, b in zip(s, e)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(spelled, pa.binary()),
                            pa.array(np.full(len(n), 0 if size is None else 1), pa.int32()),
                            pa.array(n, pa.int64()),
                        ],
                        ["spelled", "stem", "n"],
                    )

    form = "spelled binary, stem int, n long"
    count = lambda df: df.groupBy("spelled", "stem").agg(F.sum("n").alias("n"))
    least = max(3, toxic // 250)
    of_toxic = count(sample.filter("label = 1").select("text").mapInArrow(spellings, form)).filter(
        F.col("n") >= least
    )
    of_clean = count(sample.filter("label = 0").select("text").mapInArrow(spellings, form))
    both = settle(
        of_toxic.join(of_clean.withColumnRenamed("n", "other"), ["spelled", "stem"], "left").fillna(0, ["other"]),
        "spellings",
    )
    share = (F.col("n") + F.col("other")) / F.lit(float(toxic + clean))
    in_toxic = F.col("n") * F.log(F.col("n") / (toxic * share))
    in_clean = F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / (clean * share))).otherwise(0.0)
    # Beyond this ratio lie all whose probability by chance is below CHANCE: at most the sample's spellings.
    likely = both.withColumn("gain", in_toxic + in_clean).filter(F.col("gain") >= _LEAST_GAIN)
    rows = likely.orderBy(F.desc("gain"), "spelled", "stem").collect()
    return lexicon_from(
        [(bytes(r["spelled"]), r["stem"], r["n"], r["other"]) for r in rows[: learned(rows, both.count())]],
        toxic,
        clean,
    )


def by_chance(gain: float) -> float:
    """The probability that a spelling without meaning has this log-likelihood ratio (chi squared, one degree)."""
    return math.erfc(math.sqrt(max(0.0, gain)))


# by_chance(1.3) is 0.107.
_LEAST_GAIN = 1.3


def learned(rows: list, candidates: int) -> int:
    """How many of the ``rows``, by falling gain, are learned of so many candidates."""
    fit = [i for i, r in enumerate(rows, 1) if by_chance(r["gain"]) * candidates <= CHANCE * i]
    return max(fit, default=0)


def lexicon_from(counts: list[tuple[bytes, int, int, int]], toxic: int, clean: int) -> Lexicon:
    """Choose spellings by their log-likelihood ratio, the shortest that says as much as any."""
    chosen = []
    for spelled, stem, a, b in counts:
        weight = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
        if weight < 2:
            continue
        share = (a + b) / (toxic + clean)
        gain = a * np.log(a / (toxic * share)) + (b * np.log(b / (clean * share)) if b else 0)
        chosen.append((gain, -len(spelled), spelled, stem, min(float(weight), 6.0)))
    chosen.sort(key=lambda c: (-c[0], c[1], c[2], -c[3]))
    entries = dict(seed_lexicon().entries)
    stems: list[bytes] = []
    for _, _, spelled, stem, weight in chosen:
        if any(spelled.startswith(s) for s in stems):
            continue
        name = spelled.decode("utf-8", "surrogateescape") + "*" * stem
        if entries.get(name, (INSULT, 0))[0] == INSULT:
            entries[name] = (INSULT, weight)
        if stem:
            stems.append(spelled)
    return Lexicon(entries)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    sample = labelled_sample(docs, labels, "toxic", rows, size)
    first = F.pmod(F.col("turn"), F.lit(2)) == 0
    lexicon = learn_lexicon(sample.filter(first))
    load = send(docs.sparkSession, lexicon)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = load()
        for batch in batches:
            for part in pieces(batch, "text"):
                x = features(part["text"], learned)
                blobs = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part["label"], blobs], ["label", "x"])

    other = sample.filter(~first).select("text", "label")
    found = sorted((r["label"], bytes(r["x"])) for r in other.mapInArrow(described, "label int, x binary").collect())
    x = np.array([np.frombuffer(r[1]) for r in found]).reshape(-1, FEATURES)
    return Model(lexicon, fit(x, np.array([r[0] for r in found], np.float64)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    load = send(docs.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = load()
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = part["doc_id"].cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(fitted.score(part["text"]))], ["doc_id", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored(docs, train(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
