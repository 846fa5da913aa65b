"""A corpus pipeline: each stage calls one operator, and its result is written and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from upland.llm import exact_dedup, mixing, ngram_join, quality, sentencepieces
from upland.llm.common import stash


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the positive-unlabelled classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts."""
    return ngram_join.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out to meet the sources' target weights."""
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, as piece ids."""
    return sentencepieces.encode(docs)


STAGES = [("quality classifier", quality_filter), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", source_mix), ("SentencePiece encoding", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs)
    return docs
