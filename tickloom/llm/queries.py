"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import (
    hard_negatives, language_id, line_dedup, minhash, mixing, oracles, periodic_runs, quality_rules,
    sentence_pieces, site_quality, suffix_dedup, toxicity, vantage, window_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.cuts(_documents(spark, folder))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(_documents(spark, folder))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return site_quality.scored(site_quality.by_source(_documents(spark, folder)), _labels(spark, folder))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_pieces.checked(_documents(spark, folder))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(_documents(spark, folder), _labels(spark, folder))


def op6_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.takes(_documents(spark, folder))


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vantage.nearest(vectors, F.col("id") % 20 == 0)


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return window_dedup.cuts(_documents(spark, folder))


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.groups(_documents(spark, folder), size=4, percent=80)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(_documents(spark, folder))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.runs(periodic_runs.with_periodic_tails(_documents(spark, folder))))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(hard_negatives.quantised(vectors), F.col("id") % 50 == 0)


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.cuts(_documents(spark, folder)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_suffix_array_dedup, op2_language_id, op3_quality_classifier, op4_sentencepiece,
        op5_toxicity, op6_mixing_sources, op7_nearest_neighbours, op8_substring_dedup,
        op9_minhash_near_dedup, op10_quality_rules, op11_periodic_runs, op12_hard_negatives,
        op13_line_dedup,
    )
}

#: The others return draws, learned models or pieces; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": oracles.SUFFIX_DEDUP,
    "op8_substring_dedup": oracles.WINDOW_DEDUP,
    "op9_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op11_periodic_runs": oracles.PERIODIC_RUNS,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_line_dedup": oracles.LINE_DEDUP,
}
