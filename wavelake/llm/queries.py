"""The registered query of each operator, and SQL where it can say the same."""

from __future__ import annotations

import hashlib
import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, decontamination, hard_negatives, language_id, license_scan, lm_scoring, order_minhash, probminhash, quality, records, substring_dedup, toxicity
from .common import documents, scratch
from .labelled import fold, predictions


def crc_of(ids) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "records")
    records.write_records(documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return records.read_records(spark, out, crc_of).withColumnRenamed("digest", "ids_crc32")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.round_trip(documents(spark, sf_dir), vocabulary)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predictions(toxicity.score(docs, model), 0.5)


def sha256_of(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def substring_digest(found: DataFrame) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.col("value").alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(substring_dedup.deduplicated(documents(spark, sf_dir), sha256_of))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.log_probabilities(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), fold() == 1)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predictions(quality.score(docs, model), 0.3)


def contamination_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_classes(documents(spark, sf_dir)).select("doc_id", "text_id", "class_id")


def order_minhash_digest(pairs: DataFrame) -> DataFrame:
    own = F.col("entries")
    return pairs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.fingerprint(own).alias("fingerprint"),
        order_minhash.fingerprint(F.col("edited_entries")).alias("edited_fingerprint"),
        order_minhash.likeness(own, F.col("edited_entries")).alias("near_edited"),
        order_minhash.likeness(own, F.col("next_entries")).alias("near_next"),
    )


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash_digest(order_minhash.edited_pairs(documents(spark, sf_dir)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(hard_negatives.usable(vectors), F.col("id") % 100 == 0)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = fold(of=4) == 2
    found = language_id.predict(docs, language_id.fit(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "lang_pred", "score", "languages", "proportions")


QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_probminhash": op8_probminhash,
    "op9_order_minhash": op9_order_minhash,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_language_id": op13_language_id,
}
ORACLE_SQL: dict[str, str] = {"op2_license_scan": license_scan.oracle(), "op12_hard_negatives": hard_negatives.ORACLE}
