"""Queries that run streams over the derived tables, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi as kp
from ..operators import logs as lg
from ..session import written
from ..streaming import streams as st
from .fixtures import ctes, table
from .kpi import REGRESSIONS
from .learning import place
from .logs import lines
from .registry import query


def stream(spark, df):
    """df as a stream of two batches: the lower half of the values of its first column, then the upper, each in many files by ranges of it."""
    at, key = place(spark, "source"), df.columns[0]
    middle = df.agg(F.percentile_approx(key, 0.5)).first()[0]
    df.where(F.col(key) <= middle).repartitionByRange(key).write.parquet(at)
    files = max(1, len(spark.read.schema(df.schema).parquet(at).inputFiles()))
    df.where(F.col(key) > middle).repartitionByRange(files, key).write.mode("append").parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(at)


@query("stream_regressions", f"{REGRESSIONS} SELECT id, scope_key, verdict FROM found")
def stream_regressions(spark, sf):
    k = table(spark, sf, "kpi")
    sink = place(spark, "sink")
    st.run(st.stream_regressions(stream(spark, k), kp.baselines(k)).select("id", "scope_key", "verdict"), place(spark, "checkpoint"), sink)
    return spark.read.parquet(sink)


@query("stream_kpi_rollup", f"{ctes('kpi')} SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, endpoint_name, probe, count(*) AS n, round(avg(value), 6) AS avg_value FROM kpi WHERE ok AND value IS NOT NULL GROUP BY ALL")
def stream_kpi_rollup(spark, sf):
    k, at = table(spark, sf, "kpi"), place(spark, "rollup")
    # windows that are still open at the end are taken from the last batch, so all of them are compared
    st.run(st.stream_kpi_rollup(stream(spark, k), "1 day", "400 days"), place(spark, "checkpoint"), each=lambda b, i: b.write.mode("overwrite").parquet(f"{at}/{i}"), mode="update")
    got = spark.read.option("recursiveFileLookup", "true").parquet(at)
    newest = got.groupBy("start", "endpoint_name", "probe").agg(F.max_by(F.struct("n", "avg_value"), "n").alias("x"))
    return newest.select(F.unix_seconds("start").alias("start"), "endpoint_name", "probe", F.col("x.n").alias("n"), F.round("x.avg_value", 6).alias("avg_value"))


@query("stream_jitter", f"{ctes('kpi')}, s AS (SELECT *, abs(value - lag(value) OVER w) AS d, row_number() OVER w AS i, count(*) OVER (PARTITION BY endpoint_name) AS n FROM kpi WHERE ok AND value IS NOT NULL AND probe = 'icmp_rtt' WINDOW w AS (PARTITION BY endpoint_name ORDER BY id)) SELECT endpoint_name, round(coalesce(sum(d / 16 * pow(15.0 / 16, n - i)), 0.0), 6) AS jitter FROM s GROUP BY ALL")
def stream_jitter(spark, sf):
    k = table(spark, sf, "kpi").where("probe = 'icmp_rtt'")
    at = place(spark, "jitter")
    st.run(st.stream_jitter(stream(spark, k), "endpoint_name"), place(spark, "checkpoint"), each=lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{at}/{i}"), mode="update")
    got = spark.read.option("recursiveFileLookup", "true").parquet(at)
    return got.groupBy("endpoint_name").agg(F.round(F.max_by("jitter", "batch"), 6).alias("jitter"))


@query("stream_template_counts")
def stream_template_counts(spark, sf):
    l, at = written(lines(spark, sf).select("line_no", "tag", "message"), "lines"), place(spark, "counts")
    templates = written(lg.drain_templates(l), "templates")
    st.run(stream(spark, l), place(spark, "checkpoint"), each=st.append_changes(at, lambda batch: st.template_counts(batch, templates), st.sum_counts))
    return st.sum_counts(st.changes(spark, at, "template_id long, hits long"))


@query("stream_results_dedup", f"{ctes('results')} SELECT run_id, nodeid, attempt, id, outcome FROM results")
def stream_results_dedup(spark, sf):
    r = table(spark, sf, "results").select("id", "run_id", "nodeid", "attempt", "outcome", F.col("started_at").alias("ts"))
    # each fifth record comes once more as it is, and once as an older one
    old = r.where("id % 5 = 0")
    both = r.unionByName(old).unionByName(old.withColumn("id", F.col("id") - 1_000_000))
    at = place(spark, "latest")
    fresh = st.first_seen(stream(spark, both), ["run_id", "nodeid", "attempt", "id"], late="10000 days")
    st.run(fresh, place(spark, "checkpoint"), each=st.append_changes(at, st.latest_results, st.latest_results))
    got = st.changes(spark, at, both.withColumn("ts", F.col("ts").cast("timestamp")).schema)
    return st.latest_results(got).select("run_id", "nodeid", "attempt", "id", "outcome")
