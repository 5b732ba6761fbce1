"""Streams that are stopped and started again, late and repeated rows, and folders of changes that stay small."""

import os

from pyspark.sql import functions as F

from wavelake.streaming import streams as st

SCHEMA = "id long, run_id long, nodeid string, attempt int, outcome string, ts timestamp"


def put(spark, folder, *rows):
    """One file of rows (id, nodeid, outcome, minute)."""
    made = [(i, 1, n, 1, o, 1_735_000_000 + m * 60) for i, n, o, m in rows]
    spark.createDataFrame(made, "id long, run_id long, nodeid string, attempt int, outcome string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(folder)


def test_restart_repeats_and_late_rows(spark, tmp_path):
    source, at, checkpoint = (f"{tmp_path}/{x}" for x in ("source", "at", "checkpoint"))

    def drive():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        seen = []
        write = st.append_changes(at, st.latest_results, st.latest_results, every=3)
        st.run(st.first_seen(stream, ["nodeid", "id"], late="10 minutes"), checkpoint, each=lambda b, n: (seen.extend(r.id for r in b.select("id").collect()), write(b, n)))
        return sorted(seen)

    put(spark, source, (1, "a", "failed", 0), (1, "a", "failed", 0), (2, "b", "passed", 1))
    assert drive() == [1, 2]
    # another run from the checkpoint: the repeat of 1 is known, 3 is new
    put(spark, source, (1, "a", "failed", 0), (3, "a", "passed", 60))
    assert drive() == [3]
    # now an hour is past, so minute 5 is too late
    put(spark, source, (4, "c", "passed", 5))
    put(spark, source, (5, "c", "failed", 61))
    assert drive() == [5]
    got = st.latest_results(st.changes(spark, at, SCHEMA))
    assert sorted((r.nodeid, r.id, r.outcome) for r in got.collect()) == [("a", 3, "passed"), ("b", 2, "passed"), ("c", 5, "failed")]


def test_folders_stay_few(spark, tmp_path):
    at = f"{tmp_path}/counts"
    write = st.append_changes(at, lambda b: b, st.sum_counts, every=4)
    most = 0
    for n in range(23):
        write(spark.createDataFrame([(n % 3, 1)], "template_id long, hits long"), n)
        most = max(most, len(os.listdir(at)))
        if n % 5 == 0:
            write(spark.createDataFrame([(n % 3, 1)], "template_id long, hits long"), n)  # a batch comes again
    assert most <= 8
    total = {r.template_id: r.hits for r in st.sum_counts(st.changes(spark, at, "template_id long, hits long")).collect()}
    assert total == {0: 8, 1: 8, 2: 7}
    # a crash after merging, before deleting: what is merged is not counted twice
    spark.createDataFrame([(0, 100)], "template_id long, hits long").write.parquet(f"{at}/batch=5")
    assert {r.template_id: r.hits for r in st.sum_counts(st.changes(spark, at, "template_id long, hits long")).collect()} == total
    # a folder without a mark of its end is not there
    os.makedirs(f"{at}/upto=99")
    assert st.changes(spark, at, "template_id long, hits long").count() > 0
