"""Corpus pipeline: quality, language, near-duplicates, mix, and piece ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; the
caller writes a stage's rows as Parquet and rereads them as the next one's docs.  All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import jaccard_tgm, langid_gru, mixing, quality_fm, spm_wfst
from pagewright.llm.common import small_batches, written
from pagewright.llm.token_index import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on labelled rows outside the held-out fold, scores 0.3 or more."""
    small_batches(spark)
    return quality_fm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found; rows without a letter go, unless no language could be learned."""
    small_batches(spark)
    return langid_gru.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that share three quarters of their five-word shingles."""
    small_batches(spark)
    return jaccard_tgm.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's share of the words asks for."""
    return mixing.take(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row's text."""
    small_batches(spark)
    return spm_wfst.encode(docs, tokenizer_path(spm_wfst.MODEL), keep=("doc_id", "source", "lang"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("pieces", pieces)]

#: The fitted classifiers and the encoder are no SQL; tests/llm checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
