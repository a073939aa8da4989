"""From raw documents to token ids: quality, near-duplicates, benchmark passages, mixing, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet
to the shared folder and read back as the docs of the next one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.decontaminate import without_benchmark
from tablewright.llm.knn_quality import good_documents
from tablewright.llm.mixing import mixed_documents
from tablewright.llm.near_dup import one_of_each
from tablewright.llm.shared import shared_folder, written
from tablewright.llm.token_output import token_digests


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours of their text call good."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written and read back: one row per document with its place, length and checksum."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return token_digests(docs, public_tokenizers.path("word_bpe_49k.json"), folder)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_output),
]

#: Nearest neighbours, signatures and a tokenizer are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
