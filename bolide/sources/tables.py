"""Rocks, slugs and feeds projected from the parquet tables of one folder.

Times are seconds since 2024-01-01 00:00:00, as doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rocks(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    d = lambda c: c.cast("double")
    return table(spark, folder, "supplier").select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        (1 + key % 9).alias("mass"),
        F.when(
            key % 5 != 0, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))
        ).alias("target"),
        d(key % 60).alias("fired_s"),
        (d(key % 3) / 100).alias("m_theta"),
        (F.lit(0.1) + d(key % 8) / 4).alias("b_theta"),
        F.when(key % 7 == 0, F.lit(0.01)).otherwise(F.lit(0.0)).alias("m_phi"),
        (F.lit(0.1) + d(key % 4) * 3 / 4).alias("b_phi"),
        d(1000 + (key * 37) % 1000).alias("r_0"),
        d(0 - (key % 5)).alias("v"),
    )


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    d = lambda c: c.cast("double")
    return table(spark, folder, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.when(key % 4 != 0, F.col("c_mktsegment")).alias("target"),
        d(key % 600).alias("fired_s"),
        (F.lit(0.1) + d(key * 7 % 8) / 4).alias("theta"),
        (F.lit(0.1) + F.floor(d(key % 32) / 8) * 3 / 4).alias("phi"),
        d(1 + key % 20).alias("v"),
    )


def observations(rocks_df: DataFrame, shots: int = 4) -> DataFrame:
    """Exact positions of each rock at 10, 15, 20, ... seconds after launch."""
    age = F.lit(10) + F.lit(5) * F.col("obs_no")
    return (
        rocks_df.withColumn("obs_no", F.explode(F.sequence(F.lit(0), F.lit(shots - 1))))
        .select(
            F.col("id").alias("rock_id"),
            "name",
            "fired_s",
            "obs_no",
            (F.col("fired_s") + 10 + F.lit(5) * F.col("obs_no")).alias("obs_s"),
            (F.col("r_0") + F.col("v") * age).alias("pos_r"),
            (F.col("m_theta") * age + F.col("b_theta")).alias("pos_theta"),
            (F.col("m_phi") * age + F.col("b_phi")).alias("pos_phi"),
        )
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Launch requests: client, optional name, unparsed angle, launch offset."""
    kind, event = F.col("event_type"), F.col("event_id").cast("string")
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("client"),
        F.when(kind != "click", F.concat(kind, F.lit(" "), event)).alias("name"),
        F.when(kind == "error", F.lit("abc"))
        .otherwise(F.floor("value").cast("long").cast("string"))
        .alias("theta_txt"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("int") * 10 - 100).alias(
            "fire_offset_s"
        ),
    )


def timed_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with the launch as clock text: none for every fifth, not readable for every seventh."""
    ts, event = F.col("ts").cast("timestamp"), F.col("event_id")
    later = F.timestamp_micros(F.unix_micros(ts) + F.col("fire_offset_s") * F.lit(1000000).cast("long"))
    text = F.when(event % 7 == 0, F.lit("not a time")).otherwise(F.date_format(later, "HH:mm:ss"))
    fired = F.when(event % 5 != 0, text)
    return requests(spark, folder).withColumn("fired", fired).withColumn("ts", ts)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Versioned feed ordered by (changed_at, seq) per object."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("obj_id"),
        F.col("o_orderdate").alias("changed_at"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
    )


def sped_up(slugs_df: DataFrame, from_s: float | None = None) -> DataFrame:
    """Every tenth slug ten times faster, optionally only those fired late."""
    chosen = F.col("id") % 10 == 0
    if from_s is not None:
        chosen = chosen & (F.col("fired_s") >= from_s)
    return slugs_df.withColumn("v", F.when(chosen, F.col("v") * 10).otherwise(F.col("v")))


def rock_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The mass of a rock, recorded once a day on which lines of its supplier ship."""
    daily = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_shipdate")
    return daily.agg(F.count(F.lit(1)).alias("lines"), F.max("l_quantity").alias("most")).select(
        F.col("l_suppkey").alias("rock"),
        F.col("l_shipdate").alias("changed_at"),
        F.lit(0).cast("long").alias("seq"),
        (1 + (F.col("lines") + F.floor("most")) % 9).alias("mass"),
        F.lit(False).alias("gone"),
    )


def slug_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The speed of a slug, recorded with each order; pending orders take the slug away."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("slug"),
        F.col("o_orderdate").alias("changed_at"),
        F.col("o_orderkey").alias("seq"),
        (1 + F.col("o_orderkey") % 20).cast("double").alias("v"),
        (F.col("o_orderstatus") == "P").alias("gone"),
    )


def hit_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The rock that a slug hits, recorded once a day on which its lines ship; returns take it back."""
    owners = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("slug")
    )
    lines = table(spark, folder, "lineitem").join(owners, "l_orderkey")
    return (
        lines.groupBy("slug", F.col("l_shipdate").alias("changed_at"))
        .agg(
            F.max(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("hit_no"),
            F.max("l_suppkey").alias("rock"),
            F.max(F.col("l_returnflag") == "R").alias("gone"),
        )
        .select("slug", "changed_at", F.col("hit_no").alias("seq"), "hit_no", "rock", "gone")
    )
