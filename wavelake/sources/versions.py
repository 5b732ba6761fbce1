"""Tables that change by versions: a change writes the partitions that it touches, and readers see all of it or nothing.

Rows lie under data/v=<version>/part=<value>. A version's manifest (manifests/v=<version>, Parquet) names the version in which
each of its partitions was written; it is written last, so a change that ends before that is not there. Files of
older versions stay where they are: who reads them goes on. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.results import upsert_latest
from ..session import written

MANIFEST = "part string, written_in long"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{path}/manifests")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("v=") and fs.exists(hadoop.Path(f"{path}/manifests/{n}/_SUCCESS")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, int]:
    """Partition -> the version that wrote it, of a version (the newest by default): a row for each partition, however large they are."""
    known = versions(spark, path)
    if not known:
        return {}
    at = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/v={known[-1] if version is None else version}")
    return {r["part"]: r["written_in"] for r in at.collect()}


def read_version(spark: SparkSession, path: str, schema, version: int | None = None, parts: set[str] | None = None) -> DataFrame:
    """The rows of a version (the newest by default), of some partitions or all."""
    own = manifest(spark, path, version)
    paths = [f"{path}/data/v={v}/part={p}" for p, v in sorted(own.items()) if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def put_partitions(rows: DataFrame, path: str, part: Column, touched: set[str]) -> int:
    """A new version in which the touched partitions hold rows alone (none: the partition goes) and others are as they were. part: whole numbers or plain words. Returns its number."""
    spark = rows.sparkSession
    known = versions(spark, path)
    version, was = (known[-1] + 1 if known else 0), manifest(spark, path)
    at = f"{path}/data/v={version}"
    # what a writer left that never came to its manifest is written over
    rows.withColumn("part", part.cast("string")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(at)
    there = {r["part"] for r in rows.select(part.cast("string").alias("part")).distinct().collect()}
    own = {p: v for p, v in was.items() if p not in touched} | dict.fromkeys(there, version)
    spark.createDataFrame(sorted(own.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/v={version}")
    return version


def change_partitions(spark: SparkSession, path: str, schema, part: Column, by: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """A new version in which the partitions of the rows in `by` hold what change() makes of their rows."""
    touched = {r["part"] for r in by.select(part.cast("string").alias("part")).distinct().collect()}
    return put_partitions(written(change(read_version(spark, path, schema, parts=touched)), "changed"), path, part, touched)


def upsert_version(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: str, part: Column, keep: tuple[str, ...] = ()) -> int:
    """upsert_latest() on a versioned table. part: an expression on the keys, so that a row stays in its partition."""
    return change_partitions(spark, path, updates.schema, part, updates, lambda base: upsert_latest(base, updates, keys, order, keep))


def delete_version(spark: SparkSession, path: str, schema, gone: DataFrame, keys: list[str], part: Column) -> int:
    """A new version without the rows whose keys are in gone. part: an expression on the keys."""
    return change_partitions(spark, path, schema, part, gone, lambda base: base.join(gone.select(*keys).distinct(), keys, "left_anti").select(*base.columns))
