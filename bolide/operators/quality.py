"""Request validation, rate limits and data invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bolide.plans.skew import ranked

# A launch may be asked for at most this far ahead.
MAX_AHEAD_S = 300
REQUEST_SCHEMA = "name string, target string, theta string, phi string, fired string"


def parse_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies as columns; ``malformed`` marks text that is not an object."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_json(F.col(body), REQUEST_SCHEMA + ", _bad string", options)
    names = [f.split()[0] for f in REQUEST_SCHEMA.split(", ")]
    return bodies.withColumn("_p", parsed).select(
        *bodies.columns,
        *[F.col(f"_p.{n}").alias(n) for n in names],
        (F.col("_p").isNull() | F.col("_p._bad").isNotNull()).alias("malformed"),
    )


def launch_time(clock: Column, now: Column, zone: str) -> Column:
    """An HH:MM:SS clock time on the local day of ``now``, as a UTC timestamp.

    Null where the text is no clock time.
    """
    day = F.date_format(F.from_utc_timestamp(now, zone), "yyyy-MM-dd")
    local = F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.to_utc_timestamp(local, zone)


def validated(
    requests: DataFrame,
    angles: list[str],
    offset_s: Column,
    malformed: Column | None = None,
    fired_text: Column | None = None,
) -> DataFrame:
    """Requests with parsed angles, a default name and a reason for rejection.

    ``offset_s`` is the launch time minus the request time in seconds, null
    for an immediate launch. Where ``fired_text`` was given and yet gave no offset, the
    firing time is bad. Unnamed requests are numbered in order of arrival,
    in tens; the numbering is chunked by minute.
    """
    unnamed = F.col("name").isNull()
    base = requests.withColumn("_unnamed", unnamed.cast("int"))
    numbered = ranked(
        base.filter(unnamed), ["_unnamed"], ["ts", "event_id"], F.date_trunc("minute", "ts"), "_shot"
    )
    rest = base.filter(~unnamed).withColumn("_shot", F.lit(None).cast("long"))
    named = numbered.unionByName(rest)
    numbers = {f"{a}_rad": F.col(a).try_cast("double") for a in angles}
    bad_angle = F.lit(False)
    for column in numbers.values():
        bad_angle = bad_angle | column.isNull()
    reason = (
        F.when(F.lit(False) if malformed is None else malformed, "malformed")
        .when(bad_angle, "bad angle")
        .when(F.lit(False) if fired_text is None else fired_text.isNotNull() & offset_s.isNull(), "bad firing time")
        .when(offset_s < 0, "in the past")
        .when(offset_s > MAX_AHEAD_S, "too far ahead")
    )
    default = F.concat(F.lit("shot #"), (F.col("_shot") * 10).cast("string"))
    return (
        named.withColumns(numbers)
        .withColumn("name", F.coalesce("name", default))
        .withColumn("reject_reason", reason)
        .drop("_unnamed", "_shot")
    )


def accepted(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("reject_reason").isNull())


def launched(
    requests: DataFrame, key: str, fired_s: Column, theta: Column, phi: Column, speed: Column
) -> DataFrame:
    """The slug of each accepted request."""
    return accepted(requests).select(
        F.col(key).alias("id"),
        "name",
        F.lit(None).cast("string").alias("target") if "target" not in requests.columns else "target",
        fired_s.alias("fired_s"),
        theta.alias("theta"),
        phi.alias("phi"),
        speed.alias("v"),
    )


def rate_limit_violations(requests: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Clients with more requests than ``limit`` in a fixed window."""
    return (
        requests.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "client")
        .agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > limit)
        .select("client", F.col("w.start").alias("window_start"), "requests")
    )


def constraint_violations(objects: DataFrame, required: list[str]) -> DataFrame:
    """One row per object and required column that is null."""
    broken = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    )
    return objects.select("id", F.explode(broken).alias("column"))


def quarantine(objects: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by presence of the required columns."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    return objects.filter(whole), objects.filter(~whole)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling_references(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows that name a parent which does not exist."""
    known = parent.select(F.col(key).alias(column))
    return child.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def changed_ids(feed: DataFrame, old_id: str = "old_id", new_id: str = "new_id") -> DataFrame:
    """Updates that would change an object's id; ids must stay."""
    return feed.filter(
        F.col(old_id).isNotNull() & ~F.col(old_id).eqNullSafe(F.col(new_id))
    )
