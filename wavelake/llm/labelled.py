"""Labelled rows to learn from, and what both classifiers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: About how many labelled rows a classifier is fitted on at most: the rows of least hash. Nothing else is sampled.
SAMPLE = 20_000


def fold(doc_id: str = "doc_id", of: int = 5) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, label (0 or 1) of about sample rows outside fold 0. The drawn labels are few, whatever the tables' sizes, so they are broadcast and texts stay where they are."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    own = written(own, "labels")
    n = own.count()
    if n > sample:
        most = 2**32
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(most)) < int(most * sample / n))
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(own), "doc_id").select("doc_id", "text", "label")


def predictions(scored: DataFrame, least: float) -> DataFrame:
    """scored (doc_id, score) with held_out and predicted; a row without doc_id was never learned from."""
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
