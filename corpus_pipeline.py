"""A corpus pipeline: each stage reads what the one before it wrote and decides about every row of it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clickweir.llm import language, leaks, mixing, simhash, tokens
from clickweir.session import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language stay; null texts, texts without letters and undecided ones go."""
    return language.accepted(spark, docs, language.learn(docs.where(~language.held_out())))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or as a paraphrase, go."""
    return leaks.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be not at all or up to three times."""
    return mixing.mixed(spark, docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files below the shared folder; a row per document read back from them."""
    return tokens.documents_tokens(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination),
          ("source_mixing", source_mixing), ("token_output", token_output)]
ORACLE_SQL = None  # compression, fingerprints, retrieval and tokens have no SQL form; the tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
