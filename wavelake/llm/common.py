"""What the operators share: scratch tables (of the session), and how rows reach a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, ship, written  # noqa: F401

#: Rows and bytes in an Arrow batch: texts can be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Before Python functions: the package reaches the executors, and an Arrow batch has fewer rows, so that one of long texts fits a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else docs has; a null text is an empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def bit_set(hashed: DataFrame, n: int) -> np.ndarray:
    """A bitmap of n bits with those of the column bit set: of fixed size, however many rows there are."""
    parts = hashed.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(n // 8, np.uint8)
    for r in parts:  # a built-in part p > 0 has the bits from (p - 1) * its size + 1; bit 0 is alone in part 0
        own = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little"))
        at = own + (r["part"] - 1) * 8 * len(r["bits"]) + 1 if r["part"] else own
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits
