"""What a session needs: this package on the executors, the shared folder, and tables written there."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="wavelake-"), "wavelake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("wavelake", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir. Where that is unset, one of our own, if all runs on this machine, as in tests; an error otherwise."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: the executors share no folder")
        at = "file://" + tempfile.mkdtemp(prefix="wavelake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with a number from 0 in the order of a column of distinct values: ranges are numbered inside, and start where those before them end. Only the size of each range reaches the driver."""
    spark = df.sparkSession
    df = written(df, "to-number")  # drawing the ranges would compute it once more
    ranges = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % F.lit(1 << 33)}), "ranges")
    upto, first = 0, []
    for r in sorted(ranges.groupBy("_range").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_range"]):
        first.append((r["_range"], upto))
        upto += r["n"]
    starts = spark.createDataFrame(first, "_range int, _first long")
    return ranges.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_first") + F.col("_at")).cast("int" if upto < 1 << 31 else "long")).drop("_range", "_at", "_first")
