"""Quality rules that listen to the host: rates per domain, shrunk by an empirical beta prior.

1. Each document gets its counts and, from them, the rules that it fails (``RULES``).
2. Failures are added up per host, and a beta prior is fitted to the hosts' rates rule by rule
   (moments of the beta-binomial). A host's shrunk rate is (failures + a) / (documents + a + b),
   so a host of two documents stays near the common rate and a large one keeps its own.
3. A host is *rejected* where a shrunk rate reaches ``REJECT``. Where it is at least ``SUSPECT``,
   documents that fail that rule go; below, a single odd document of a sound host stays.
4. The verdicts are joined back. ``kept`` is false if the base rules fail (fewer than 50 words,
   or over half of the words in repeated windows), else it is the host's verdict.

DataFrame functions only. The counts are made row by row: a text's three-word windows are sorted
inside the row, and equal neighbours are compared word by word. Texts over ``LONG_BYTES`` are
exploded instead and their windows grouped in a shuffle, so a very long text need not fit
in sorted form. Per host there is one row; hosts are broadcast up to ``BROADCAST_HOSTS`` of them, else
each is copied ``SALT`` times and the documents of a hot host are dealt over the copies.

Defined cases: a null text has no words, lines or symbols and fails the base rules. A null or empty
host is the host ''. Repeated doc_ids get a row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.llm.shared import numbered
from bolide.plans.settle import settle

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50

# Document rules, on the counts; all in whole numbers.
RULES = {
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
}
BASE = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words"
REJECT = 0.5
SUSPECT = 0.01

LONG_BYTES = 8 << 20
BROADCAST_HOSTS = 100_000
SALT = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array ``words``."""

    def same(a: Column, b: Column) -> Column:
        parts = [a[f] == b[f] for f in ("h", "a", "b", "c")]
        return F.coalesce(parts[0] & parts[1] & parts[2] & parts[3], F.lit(False))

    def window(words: Column) -> Callable[[Column, Column], Column]:
        def at(a: Column, i: Column) -> Column:
            b, c = F.get(words, i + 1), F.get(words, i + 2)
            hashed = F.xxhash64(a, b, c)
            return F.struct(hashed.alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("i"))

        return at

    def covered(starts: Column) -> Column:
        step = F.transform(
            starts, lambda p, j: F.least(F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(step, F.lit(0).cast("long"), lambda n, x: n + x)

    def repeated(sorted_: Column) -> Column:
        twice = F.filter(
            sorted_, lambda x, j: same(x, F.get(sorted_, j - 1)) | same(x, F.get(sorted_, j + 1))
        )
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def counted(words: Column) -> Column:
        heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
        return _let(F.sort_array(F.transform(heads, window(words))), repeated)

    return _let(words, counted)


def counts(docs: DataFrame, host: Column | str = "source", long_bytes: int = LONG_BYTES) -> DataFrame:
    """Write one narrow row per document: doc_id, _row, _host and its counts."""
    host = F.col(host) if isinstance(host, str) else host
    rows = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("_row"),
        F.coalesce(host.cast("string"), F.lit("")).alias("_host"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    is_long = F.octet_length("text") > long_bytes
    table = settle(_counted(rows, F.when(~is_long, F.lit(True))), "counts")
    if table.filter("n_repeat_words is null").isEmpty():
        return table
    longs = settle(rows.filter(is_long), "long")
    found = _repeats_of_long(longs)
    whole = _counted(longs, F.lit(None).cast("boolean")).drop("n_repeat_words").join(found, "_row", "left")
    whole = whole.withColumn("n_repeat_words", F.coalesce("n_repeat_words", F.lit(0).cast("long")))
    return settle(table.filter("n_repeat_words is not null").unionByName(whole), "counts")


def _counted(rows: DataFrame, inside_row: Column) -> DataFrame:
    """The counts of ``rows`` (doc_id, _row, _host, text); repeated words only where ``inside_row`` is true."""
    text = F.col("text")
    size = lambda a: F.size(a).cast("long")
    words = _let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            size(w).alias("n_words"), F.when(inside_row, repeat_words(w)).alias("n_repeat_words")
        ),
    )
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(_without(line, BLANKS)) > 0)
    both = _let(lines, lambda x: F.struct(size(x).alias("n"), size(F.array_distinct(x)).alias("distinct")))
    return rows.select(
        "doc_id",
        "_row",
        "_host",
        words.alias("words"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        both.alias("lines"),
    ).select(
        "doc_id",
        "_row",
        "_host",
        "words.*",
        "word_chars",
        "n_symbols",
        F.col("lines.n").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.distinct")).alias("n_dup_lines"),
    )


def _repeats_of_long(rows: DataFrame) -> DataFrame:
    """``repeat_words`` of exploded texts: _row, n_repeat_words. Windows are grouped over all tasks."""
    spoken = rows.select("_row", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("i", "w"))
    # Each word is sent to the windows that hold it.
    starts = F.sequence(F.greatest(F.col("i") - (WINDOW - 1), F.lit(0)), F.col("i"))
    sent = spoken.select("_row", F.explode(starts).alias("start"), "i", "w")
    part = lambda k: F.max(F.when(F.col("i") - F.col("start") == k, F.col("w"))).alias(f"w{k}")
    whole = sent.groupBy("_row", "start").agg(*[part(k) for k in range(WINDOW)])
    windows = settle(whole.filter(F.col(f"w{WINDOW - 1}").isNotNull()), "windows")
    by = ["_row", *[f"w{k}" for k in range(WINDOW)]]
    twice = windows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    inside = windows.join(twice, by, "left_semi").select(
        "_row", F.explode(F.sequence("start", F.col("start") + WINDOW - 1)).alias("i")
    )
    return inside.distinct().groupBy("_row").agg(F.count(F.lit(1)).alias("n_repeat_words"))


def host_rates(table: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """One row per host of written counts: _host, n, and per rule ``f_``, its failures, and ``r_``, its shrunk rate.

    The prior of a rule has the mean m = failures / documents of all hosts and the concentration
    (1 - rho) / rho, where rho is the moment estimate of the hosts' correlation,
    (sum f^2 / n - F^2 / N - (k - 1) m (1 - m)) / ((N - sum n^2 / N - (k - 1)) m (1 - m)),
    held to 1e-6 .. 1. With one host, or nothing or all failing, the rate is the plain one.
    """
    failed = [F.sum(F.expr(f"cast({rule} as int)")).cast("long").alias(f"f_{name}") for name, rule in rules.items()]
    hosts = settle(table.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *failed), "hosts")
    square = lambda c: F.col(c).cast("double") * F.col(c)
    sums = hosts.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").cast("double").alias("N"),
        F.sum(square("n")).alias("nn"),
        *[F.sum(f"f_{r}").cast("double").alias(f"F_{r}") for r in rules],
        *[F.sum(square(f"f_{r}") / F.col("n")).alias(f"ff_{r}") for r in rules],
    ).first()
    rates = []
    for r in rules:
        a, b = prior(sums["k"], sums["N"], sums["nn"], sums[f"F_{r}"], sums[f"ff_{r}"])
        rates.append(((F.col(f"f_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias(f"r_{r}"))
    return hosts.select("*", *rates)


def prior(k: int, total: float, squares: float, failed: float, spread: float) -> tuple[float, float]:
    """The beta prior (a, b) of one rule: hosts, sum n, sum n^2, sum f, sum f^2 / n."""
    if not k or k < 2 or failed <= 0 or failed >= total:
        return 0.0, 0.0
    mean = failed / total
    within = mean * (1 - mean)
    room = total - squares / total - (k - 1)
    rho = (spread - failed * failed / total - (k - 1) * within) / (room * within) if room > 0 else 0.0
    rho = min(1.0, max(1e-6, rho))
    strength = (1 - rho) / rho
    return mean * strength, (1 - mean) * strength


def verdicts(
    rates: DataFrame, rules: dict[str, str] = RULES, reject: float = REJECT, suspect: float = SUSPECT
) -> DataFrame:
    """Per host: ``_rejected``, and per rule whether documents that fail it go (``s_``)."""
    worst = F.lit(False)
    for r in rules:
        worst = worst | (F.col(f"r_{r}") >= reject)
    return rates.select(
        "_host", worst.alias("_rejected"), *[(F.col(f"r_{r}") >= suspect).alias(f"s_{r}") for r in rules]
    )


def judged(
    table: DataFrame, rules: dict[str, str] = RULES, reject: float = REJECT, suspect: float = SUSPECT
) -> DataFrame:
    """Written counts with ``base_failed``, ``host_rejected``, ``suspect_rules`` and ``kept``."""
    found = verdicts(settle(host_rates(table, rules), "rates"), rules, reject, suspect)
    if found.count() <= BROADCAST_HOSTS:
        rows = table.join(F.broadcast(found), "_host")
    else:
        copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        dealt = table.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALT)).cast("int"))
        rows = dealt.join(copies, ["_host", "_salt"])
    hit = F.filter(
        F.array(*[F.when(F.expr(rule) & F.col(f"s_{r}"), F.lit(r)) for r, rule in rules.items()]),
        lambda x: x.isNotNull(),
    )
    rows = rows.withColumn("base_failed", F.expr(BASE)).withColumn("_hit", hit)
    return rows.select(
        "doc_id",
        "_row",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
        "base_failed",
        F.col("_rejected").alias("host_rejected"),
        F.array_join("_hit", ",").alias("suspect_rules"),
        (~F.col("base_failed") & ~F.col("_rejected") & (F.size("_hit") == 0)).alias("kept"),
    )


def report(docs: DataFrame, host: Column | str = "source", **limits: float) -> DataFrame:
    """One row per document: its counts, whether the base rules fail, and whether it is kept."""
    return judged(counts(docs, host), **limits).drop("_row")


def keep_sound(docs: DataFrame, host: Column | str = "source", **limits: float) -> DataFrame:
    """The rows of ``docs`` (all columns) that are kept."""
    host = F.col(host) if isinstance(host, str) else host
    named = docs.withColumns({"_host_of_row": host})
    rows = numbered(named, "sound")
    table = counts(
        rows.select(
            F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text"), F.col("_doc._host_of_row").alias("host")
        ),
        "host",
    )
    kept = judged(table, **limits).filter("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_doc.*").drop("_host_of_row")
