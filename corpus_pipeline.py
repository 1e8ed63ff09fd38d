"""The corpus pipeline: five stages from ``documents`` to packed token sequences.

Each stage reads what its predecessor kept, stored as Parquet, and its decisions take
effect: rejected documents are gone for all later stages.

Defined cases, for every stage: null text counts as empty; extra columns, whatever their names, go along to the last
stage, which returns the columns of pieces; an empty table gives an empty one; very long texts go through whole. What a stage does with
null ids, repeated rows and ties is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, exact_dedup, near_copies, packing, quality
from textloom.llm.common import saved, table

#: Scores from here on pass.
LEAST_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: scores of LEAST_QUALITY or more pass.

    Rows are judged each by its text, so ids don't matter and repeated rows stay or go together. Without labels of both classes every score is
    the share of label 1 (0.5 without labels), which passes or rejects all.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, column="__quality").where(F.col("__quality") >= LEAST_QUALITY).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then that with the smallest id; a null id is smaller than any other.

    Of rows alike in text and id one stays.
    """
    return exact_dedup.keep_first(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles), that with the smallest id.

    The vantage-point search over fingerprints names the pairs, their shingles decide them, and groups are closed over pairs. Texts without words
    are near nothing. Rows without an id stay; rows of one id stay or go together.
    """
    gone = near_copies.near_components(docs).where("v <> root").select(F.col("v").alias("__id"))
    return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Rows without an id stay; rows of one id stay or go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences; repeated rows and rows without an id are packed each."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained model decides the first stage, which SQL can't express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, f"pipeline-{name}")
    return docs
