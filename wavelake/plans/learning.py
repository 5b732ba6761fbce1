"""Queries that fit models, and those over files."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import kpi as kp
from ..operators import learning as op
from ..operators import results as rs
from ..session import scratch
from ..sources import store
from .fixtures import ctes, table
from .logs import raw
from .registry import query
from .results import truth


place = scratch
#: Where a table is a file for each of many groups, tasks put their files in place themselves; else the driver does, one by one, at the end.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: Lines of a log file, and ids of a manifest: so neither is longer than a task can hold. Lines of an artifact.
LINES, MANIFEST, PART = 100_000, 1_000_000, 1000
#: Lines of a file of many logs, on average; what a line before a log begins with.
FILE, HEAD = 20_000, "==> "


@query("isolation_forest")
def isolation_forest(spark, sf):
    return op.isolation_forest(kp.kpi_features(table(spark, sf, "kpi")))


@query("flake_classifier")
def flake_classifier(spark, sf):
    return op.flake_classifier(rs.classified(rs.test_history(table(spark, sf, "results"))), truth(spark, sf))


@query("scan_store", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_store(spark, sf):
    return store.scan_store(spark, f"{sf}/orders.parquet", "o_orderkey bigint, o_totalprice double, o_orderstatus string").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("read_log_text", f"{ctes('log_raw')} SELECT tag, line_no, raw FROM log_raw")
def read_log_text(spark, sf):
    """The derived logs, written as text files that hold many logs each, and read again. As head and tail print many files, a line with the name goes before each log (no line of these logs begins like it); logs of over LINES lines are cut."""
    at, lines = place(spark, "logs"), raw(spark, sf)
    c, part = F.col, F.floor((F.col("line_no") - 1) / LINES).cast("long")
    # a file costs far more than its lines, so there are as many as lines ask for and not as many as tags
    files = max(1, -(-lines.count() // FILE))
    first = (c("line_no") - 1) % LINES == 0
    value = F.when(first, F.concat(F.lit(HEAD), c("part").cast("string"), F.lit(" "), F.coalesce("tag", F.lit("")), F.lit("\n"), F.coalesce("raw", F.lit("")))).otherwise(c("raw"))
    dealt = lines.withColumn("part", part).withColumn("file", F.pmod(F.xxhash64("tag", "part"), F.lit(files)))
    ordered = dealt.repartition(files, "file").sortWithinPartitions("file", "tag", "part", "line_no")
    ordered.select("file", value.alias("value")).write.options(**BY_TASKS).partitionBy("file").text(at)
    return logs_of(store.read_log_text(spark, at))


def logs_of(got):
    """tag, line_no, raw of lines (path, line_no, raw) of files that hold many logs."""
    c = F.col
    told = F.when(c("raw").startswith(HEAD), F.struct(c("line_no").alias("at"), F.split("raw", " ", 3).alias("words")))
    own = got.withColumns({"told": told, "head": F.last(told, ignorenulls=True).over(W.partitionBy("path").orderBy("line_no"))}).where("told is null")
    before = F.get("head.words", F.lit(1)).cast("int") * LINES
    return own.select(F.nullif(F.get("head.words", F.lit(2)), F.lit("")).alias("tag"), (c("line_no") - c("head.at") + before).alias("line_no"), "raw")


@query("decode_json_columns", "SELECT event_id, user_id, event_type AS kind FROM events")
def decode_json_columns(spark, sf):
    text = table(spark, sf, "events").select("event_id", F.to_json(F.struct("user_id", F.col("event_type").alias("kind"))).alias("params"))
    return store.decode_json_columns(text, params="user_id bigint, kind string").select("event_id", "params.user_id", "params.kind")


@query("read_manifest", f"{ctes('results')} SELECT 'deterministic' AS kind, 'r' || id AS tag, 'wpa2' AS scenario, 'NONE' AS fault, CAST(NULL AS BOOLEAN) AS fired, outcome = 'passed' AS ok, CAST(NULL AS INT) AS n_transitions FROM results WHERE id % 3 > 0 UNION ALL SELECT 'flake', 'r' || id, NULL, 'NONE', attempt = 1, NULL, NULL FROM results WHERE id % 3 = 0")
def read_manifest(spark, sf):
    """A manifest of each derived run, written as a line of JSON and read again."""
    at, c = place(spark, "manifest"), F.col
    r = table(spark, sf, "results")
    tag, seed, fixed = F.concat(F.lit("r"), "id").alias("tag"), c("id").alias("seed"), c("id") % 3 > 0
    one = F.struct(tag, F.lit("wpa2").alias("scenario"), F.lit("NONE").alias("fault"), seed, F.struct(F.struct((c("outcome") == "passed").alias("ok")).alias("result")).alias("summary"))
    flaky = F.struct(tag, F.lit("NONE").alias("fault"), seed, F.lit(True).alias("injected"), (c("attempt") == 1).alias("fired"))
    r.groupBy("run_id", F.floor(c("id") / MANIFEST).alias("part")).agg(F.collect_list(F.when(fixed, one)).alias("deterministic"), F.collect_list(F.when(~fixed, flaky)).alias("flake")).drop("run_id", "part").write.json(at)
    return store.read_manifest(spark, at, lines=True).select("kind", "tag", "scenario", "fault", "fired", "ok", F.when(c("transitions").isNotNull(), F.size("transitions")).alias("n_transitions"))


@query("artifact_catalog", f"""{ctes('log_raw')}, files AS (SELECT 'tag=' || tag || '/part=' || (line_no - 1) // {PART} AS name, string_agg(raw, chr(10) ORDER BY line_no) || chr(10) AS content FROM log_raw GROUP BY tag, (line_no - 1) // {PART})
SELECT name, strlen(content) AS size, 'txt' AS kind, sha256(content) AS sha256 FROM files""")
def artifact_catalog(spark, sf):
    """The derived log lines, as text files of up to PART lines of a tag, which lie in tar archives: a file of its own costs far more than what is in it."""
    at, log = place(spark, "artifacts"), raw(spark, sf)
    n = max(1, -(-log.count() // FILE))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"])
    part = F.floor((F.col("line_no") - 1) / PART).cast("string").alias("part")
    texts = log.groupBy("tag", part).agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("content"))
    store.write_tars(texts.select(F.concat(F.lit("tag="), F.coalesce("tag", F.lit("")), F.lit("/part="), "part", F.lit("/log.txt")).alias("name"), "content"), at, n)
    return store.artifact_catalog(spark, at, members=True).select(F.regexp_extract("path", r"([^/]+/[^/]+)/[^/]+$", 1).alias("name"), "size", "kind", "sha256")


@query("list_captures", f"{ctes('frames')} SELECT DISTINCT 'capture_id=' || capture_id AS name FROM frames WHERE capture_id LIKE '%1%' ORDER BY name LIMIT 40")
def list_captures(spark, sf):
    """The derived frames, written as a folder for each capture; at most 40 names, as the operator's users ask for."""
    at = place(spark, "captures")
    table(spark, sf, "frames").write.options(**BY_TASKS).partitionBy("capture_id").parquet(at)
    return store.list_captures(spark, at, "1", 40, "*.parquet").where("size > 0").select("name")


@query("append_facts", f"{ctes('kpi')} SELECT id, run_id, value FROM kpi")
def append_facts(spark, sf):
    at, k = place(spark, "facts"), table(spark, sf, "kpi")
    for part in (0, 1):
        store.append_facts(k.where(F.col("id") % 2 == part), at, "run_id")
    return spark.read.parquet(at).select("id", F.col("run_id").cast("long"), "value")
