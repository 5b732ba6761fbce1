"""A training corpus from documents: quality, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage reads what the one before it has written; all but the last return the columns of
documents. Rows with nulls, empty texts, repeated rows and an empty table pass as each
operator says; rows without doc_id pass the stages that compare documents untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import bpe, decontamination, probminhash, quality, substring_dedup
from wavelake.llm.common import written

#: A document whose quality score is less goes.
LEAST_QUALITY = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier, fitted on the labels of these documents, rejects."""
    return quality.good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of near-duplicates."""
    return probminhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the words of passages that a document with a smaller doc_id has."""
    return substring_dedup.rewritten(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), their SHA-256, and that of the bytes they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.round_trip(docs, vocabulary)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good_quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("benchmark leaks", benchmark_leaks), ("token ids", token_ids)]

#: No SQL: the first two stages can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
