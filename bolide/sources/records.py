"""Record shapes of the public tables, defaults, and flat/nested conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bolide.functions.numeric import at_seconds, elapsed_seconds
from bolide.functions.position import SHOT_FIELDS, TRACK_FIELDS

ROCK_PARAMS_TYPE = (
    "struct<m_theta:double,b_theta:double,m_phi:double,b_phi:double,r_0:double,v:double>"
)
SLUG_PARAMS_TYPE = "struct<theta:double,phi:double,v:double>"
ROCK_SCHEMA = (
    f"id long, name string, mass long, target string, fired timestamp, params {ROCK_PARAMS_TYPE}"
)
SLUG_SCHEMA = f"id long, name string, target string, fired timestamp, params {SLUG_PARAMS_TYPE}"
DEFAULT_MASS = 4


def rock_records(spark: SparkSession, rows: list[tuple], now: str) -> DataFrame:
    """Seed rocks (id, name, mass, target, fired, params) with defaults filled in."""
    df = spark.createDataFrame(rows, ROCK_SCHEMA)
    return with_defaults(df, now).withColumn("mass", F.coalesce("mass", F.lit(DEFAULT_MASS)))


def slug_records(spark: SparkSession, rows: list[tuple], now: str) -> DataFrame:
    return with_defaults(spark.createDataFrame(rows, SLUG_SCHEMA), now)


def with_defaults(df: DataFrame, now: str) -> DataFrame:
    """Launch time defaults to now, each launch parameter to zero with its struct."""
    params = df.schema["params"].dataType
    zero = F.struct(*[F.lit(0.0).alias(f) for f in params.fieldNames()])
    return df.withColumn(
        "fired", F.coalesce("fired", F.lit(now).cast("timestamp"))
    ).withColumn("params", F.coalesce("params", zero))


def _flat(df: DataFrame, names: list[str], epoch: str, params: tuple[str, ...]) -> DataFrame:
    fired = elapsed_seconds(F.col("fired"), F.lit(epoch))
    return df.select(
        *names, fired.alias("fired_s"), *[F.col(f"params.{p}").alias(p) for p in params]
    )


def flat_rocks(records: DataFrame, epoch: str) -> DataFrame:
    """Flat columns with seconds since ``epoch``, as the operators take them."""
    return _flat(records, ["id", "name", "mass", "target"], epoch, TRACK_FIELDS[1:])


def flat_slugs(records: DataFrame, epoch: str) -> DataFrame:
    return _flat(records, ["id", "name", "target"], epoch, SHOT_FIELDS[1:])


def nested(df: DataFrame, epoch: str, params: tuple[str, ...]) -> DataFrame:
    """Back to timestamps and a params struct."""
    other = [c for c in df.columns if c not in (*params, "fired_s")]
    return df.select(
        *other,
        at_seconds(F.lit(epoch), F.col("fired_s")).alias("fired"),
        F.struct(*params).alias("params"),
    )


def set_param(records: DataFrame, where: Column, field: str, value: Column) -> DataFrame:
    """Change one launch parameter of the rows where a condition holds."""
    changed = F.col("params").withField(field, value.cast("double"))
    return records.withColumn("params", F.when(where, changed).otherwise(F.col("params")))


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, one per line, with ISO-8601 timestamps."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    df.write.mode("overwrite").options(**options).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
