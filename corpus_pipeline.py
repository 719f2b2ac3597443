"""The training-data pipeline: five operators in a row, each over what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm import bpe, cotraining, decontaminate, simhash, suffix_array
from duskwatch.llm.common import small_batches
from duskwatch.session import new_folder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fitting a classifier, and a byte-pair vocabulary, are outside what SQL can say.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the co-trained classifier does not reject; without labels of both kinds, all."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotraining.classify(docs, labels).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies; empty texts are copies of each other."""
    small_batches(spark)
    return simhash.keep_one_per_component(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated strings cut out of their texts; a null text stays null."""
    small_batches(spark)
    cut = suffix_array.deduplicate(docs, keep_first=True).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("bigint"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; a null text holds none."""
    small_batches(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids; the text is the decoding of these ids, a null text has no ids."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_substrings),
    ("benchmark_decontamination", benchmark_free),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
