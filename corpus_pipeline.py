"""The corpus pipeline: documents in, token ids of the training mix out.

Every stage works on all that the one before it kept; what it returns is stored
as Parquet in the cluster's shared folder and read again by the next. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import minhash, mixing, quality_rules, sentence_pieces, suffix_dedup
from tickloom.session import write_and_reread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.accepted(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the least doc_id stays."""
    return minhash.dedup(docs, size=5, percent=80)


def suffix_array_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut."""
    return suffix_dedup.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them, repeats included."""
    return mixing.mixed(docs)


def sentence_pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids) of the mix."""
    return sentence_pieces.encoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_array_dedup_stage),
    ("mixing_sources", mixing_stage),
    ("sentence_pieces", sentence_pieces_stage),
]

#: SQL has neither the permutations of the mix nor the merges of pieces; the
#: tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, on the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = write_and_reread(docs)
    return docs
