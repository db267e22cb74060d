"""One query per corpus operator, with the SQL that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bolide.llm import (
    divergence,
    exact_dedup,
    host_rules,
    huffman_ids,
    icws_dedup,
    line_dedup,
    lm_difference,
    packing,
    phrase_index,
    quality_mil,
    shard_tree,
    token_alignment,
    toxicity_fst,
)
from bolide.llm.oracles import ORACLES
from bolide.llm.shared import table

__all__ = ["ORACLES", "QUERIES"]

END_ID = 2
SHARDS = 16


def op1_lm_difference(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").filter("quality = 1")
    return lm_difference.scores(table(spark, folder, "documents"), good)


def op2_shard_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = shard_tree.assign(
        table(spark, folder, "documents"),
        shard_tree.default_tree(SHARDS),
        shard_tree.default_tree(SHARDS + 1),
    )
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op3_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = huffman_ids.new_folder(spark)
    huffman_ids.write_ids(
        table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID
    )
    return huffman_ids.decoded(spark, path, "crc")


def op4_phrase_index(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_index.report(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    ).drop("n_near_items")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(table(spark, folder, "documents"))


def op6_quality_mil(spark: SparkSession, folder: str) -> DataFrame:
    return quality_mil.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op8_icws_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return icws_dedup.near_duplicates(table(spark, folder, "documents"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op10_toxicity_fst(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_fst.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return host_rules.report(table(spark, folder, "documents"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.report(
        table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_difference,
        op2_shard_tree,
        op3_huffman_ids,
        op4_phrase_index,
        op5_line_dedup,
        op6_quality_mil,
        op7_packing,
        op8_icws_dedup,
        op9_exact_dedup,
        op10_toxicity_fst,
        op11_host_rules,
        op12_divergence,
        op13_token_alignment,
    )
}
