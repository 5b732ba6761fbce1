"""Streams of samples, lines and results. Each takes a streaming DataFrame; run() drives it over what is there and ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kpi as fk
from ..operators.kpi import usable, verdicts
from ..operators.logs import match_template
from ..operators.results import upsert_latest
from ..session import ship


def stream_regressions(samples: DataFrame, baselines: DataFrame) -> DataFrame:
    """A verdict for each sample as it comes, against stored baselines."""
    return verdicts(usable(samples).withColumn("scope_key", fk.scope_key()).join(baselines.drop("unit"), "scope_key", "left"))


def stream_kpi_rollup(samples: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Average and number of each endpoint and probe by window; samples later than late don't count."""
    own = usable(samples).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", window).alias("w"), "endpoint_name", "probe").agg(F.count("*").alias("n"), F.avg("value").alias("avg_value")).select(F.col("w.start").alias("start"), "endpoint_name", "probe", "n", "avg_value")


def stream_jitter(samples: DataFrame, *keys: str) -> DataFrame:
    """The jitter of each key after each batch: state is the last value and the jitter so far. Samples of a batch are taken in order of id: a key's id and value are held, two numbers a sample, so the source's limits on a batch bound it."""
    ship(samples.sparkSession)
    kinds = dict(samples.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, jitter = state.get if state.exists else (None, 0.0)
        chunks = [(b["id"].to_numpy(), b["value"].to_numpy()) for b in batches]
        ids, values = (np.concatenate(x) for x in zip(*chunks, strict=True))
        for value in values[np.argsort(ids, kind="stable")].tolist():
            jitter, last = jitter + (0.0 if last is None else (abs(value - last) - jitter) / 16), value
        state.update((last, jitter))
        yield pd.DataFrame([(*key, jitter)], columns=[*keys, "jitter"])

    return usable(samples).select(*keys, "id", "value").groupBy(*keys).applyInPandasWithState(step, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", jitter double", "last double, jitter double", "update", "NoTimeout")


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """The complete folders kind=<number> under path, by their number."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    names = [str(x.getPath().getName()) for x in fs.listStatus(at)]
    return {int(n.partition("=")[2]): f"{path}/{n}" for n in names if n.startswith(f"{kind}=") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))}


def append_changes(path: str, change, merge=None, every: int = 10):
    """A foreachBatch function that keeps a table as changes under path: change(batch) is written once for each batch (batch=<number>), and merged when read. A repeated batch writes the change that it wrote before.

    With merge (a function of all changes to what they come to, in the same columns), each `every`-th batch puts what is there together as upto=<number>, and what that holds is deleted, so no more than 2 * every
    folders are there at any time. Readers take the newest complete upto and the batches after it, so a crash between writing and deleting changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= max(_folders(spark, path, "upto"), default=-1):
            return  # repeated after a crash, and merged already
        own = change(batch)
        own.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if merge and (number + 1) % every == 0:
            old = [*_folders(spark, path, "upto").values(), *_folders(spark, path, "batch").values()]
            merge(changes(spark, path, own.schema)).write.mode("overwrite").parquet(f"{path}/upto={number}")
            hadoop = spark._jvm.org.apache.hadoop.fs
            fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
            for folder in old:
                fs.delete(hadoop.Path(folder), True)

    return write


def changes(spark: SparkSession, path: str, schema) -> DataFrame:
    """All changes under path: the newest merged ones and those since."""
    merged, batches = _folders(spark, path, "upto"), _folders(spark, path, "batch")
    newest = max(merged, default=-1)
    paths = [*(merged[newest] for _ in range(newest >= 0)), *(at for n, at in sorted(batches.items()) if n > newest)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def first_seen(records: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """records without repeats of their keys: a row counts once, and rows later than `late` behind the newest don't count. What is held for each key goes when the watermark has passed it."""
    return records.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def template_counts(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """template_id, hits of the lines; sum_counts() merges those of many batches."""
    return match_template(lines, templates).where("template_id is not null").groupBy("template_id").agg(F.count("*").alias("hits"))


def sum_counts(all_changes: DataFrame) -> DataFrame:
    return all_changes.groupBy("template_id").agg(F.sum("hits").alias("hits"))


def latest_results(records: DataFrame) -> DataFrame:
    """The newest record of each (run, test, attempt), of a batch or of the changes of many."""
    return upsert_latest(records.limit(0), records, ["run_id", "nodeid", "attempt"], "id")


#: Where state lives: on the executors' disks and in the checkpoint, not on the heap.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, checkpoint: str, sink: str | None = None, each=None, mode: str = "append") -> None:
    """Drives a stream over all that is there: into a Parquet sink, or through each(batch, number). State is kept in RocksDB."""
    key, spark = "spark.sql.streaming.stateStore.providerClass", stream.sparkSession
    was = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        _driven(stream, checkpoint, sink, each, mode)
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)


def _driven(stream: DataFrame, checkpoint: str, sink: str | None, each, mode: str) -> None:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(sink)
    query.awaitTermination()
