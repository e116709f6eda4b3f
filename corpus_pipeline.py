"""Corpus pipeline: toxicity filter, near-duplicate removal, source mix, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linktrove.llm.batches import small_batches
from linktrove.llm.bpe_stream import codec_digests
from linktrove.llm.cube_mix import mixed_documents
from linktrove.llm.dart_minhash import keep_one
from linktrove.llm.toxicity import fit, keep_clean
from linktrove.llm.vocab import vocabulary_path
from linktrove.sources.scratch import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the limit stay."""
    small_batches(spark)
    return keep_clean(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    small_batches(spark)
    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    small_batches(spark)
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    small_batches(spark)
    return codec_digests(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("source_mix", source_mix), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, spark)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None
