"""A training corpus from ``documents``: five stages, each a corpus operator.

A stage takes (spark, docs, folder of the tables) and returns a DataFrame. ``run`` writes what
a stage returns as Parquet in the shared checkpoint folder and reads it back for the next.
The tables that a stage settles for itself are deleted when the next stage begins, as its result has
been written by then; stages run one after the other, and a result must be written before the next is called.

Defined cases, for every stage: null texts count as empty, null doc_ids come after all others, repeated
rows are documents of their own (exact dedup keeps one), columns beyond those of ``documents``
pass through whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from bolide.llm import exact_dedup, icws_dedup, packing, phrase_index, quality_mil
from bolide.llm.shared import table
from bolide.plans.settle import checkpoint_root, noted, release

# Settled tables of the last stage that was called.
_held: list[str] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _held)
        with noted() as own:
            out = function(spark, docs, sf_dir)
        _held[:] = own
        return out

    return run_stage


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_mil.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return icws_dedup.drop_near_copies(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return phrase_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their bins."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The classifier is fitted, which SQL can't express; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{checkpoint_root(spark)}/bolide/stage{number}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
