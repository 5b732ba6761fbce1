"""Queries over test attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as op
from ..session import scratch
from ..sources import versions as ver
from .fixtures import ctes, table
from .registry import query

RESULTS = ctes("results")
FINAL = f"{RESULTS}, final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, nodeid ORDER BY attempt DESC) AS rank FROM results) WHERE rank = 1)"
BAD = "outcome IN ('failed', 'error')"
FLAKES = f"""{RESULTS}, marked AS (SELECT *, coalesce(min(attempt) FILTER ({BAD}) OVER w < max(attempt) FILTER (outcome = 'passed') OVER w, false) AS is_flake, count(*) OVER w AS total_attempts FROM results WINDOW w AS (PARTITION BY run_id, nodeid))"""
HISTORY = f"""{FINAL}, h AS (SELECT nodeid, run_id, outcome = 'passed' AS passed FROM final WHERE outcome IN ('passed', 'failed')),
ch AS (SELECT *, CASE WHEN passed <> lag(passed) OVER (PARTITION BY nodeid ORDER BY run_id) THEN 1 ELSE 0 END AS changed FROM h),
isl AS (SELECT *, sum(changed) OVER (PARTITION BY nodeid ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS island FROM ch),
st AS (SELECT nodeid, island, count(*) AS n, bool_and(passed) AS passed FROM isl GROUP BY ALL),
hist AS (SELECT nodeid, CAST(sum(n) AS BIGINT) AS runs, CAST(sum(CASE WHEN passed THEN n ELSE 0 END) AS BIGINT) AS passes, CAST(max(island) AS BIGINT) AS transitions, max(n) AS longest_streak, arg_max(passed, island) AS last_passed FROM st GROUP BY nodeid),
rates AS (SELECT *, passes / runs AS pass_rate, least(passes, runs - passes) / runs AS flake_rate, CASE WHEN runs > 1 THEN transitions / (runs - 1) ELSE 0.0 END AS transition_rate FROM hist),
classes AS (SELECT *, CASE WHEN passes = runs THEN 'stable' WHEN passes = 0 THEN 'failing' WHEN transitions >= 2 AND flake_rate >= 0.1 THEN 'flaky' WHEN transitions = 1 AND last_passed THEN 'fixed' WHEN transitions = 1 THEN 'regressed' ELSE 'stable' END AS class, runs >= 4 AND flake_rate >= 0.1 AND transitions >= 2 AS is_flaky FROM rates)"""


def results(spark, sf):
    return table(spark, sf, "results")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("final_results", f"{FINAL} SELECT run_id, nodeid, attempt, outcome, id FROM final")
def final_results(spark, sf):
    return op.final_results(results(spark, sf)).select("run_id", "nodeid", "attempt", "outcome", "id")


@query("failed_results", f"{FINAL} SELECT id, run_id, nodeid, outcome FROM final WHERE {BAD} AND run_id = (SELECT max(run_id) FROM results)")
def failed_results(spark, sf):
    return op.failed_results(results(spark, sf)).select("id", "run_id", "nodeid", "outcome")


@query("latest_run", f"{RESULTS} SELECT max(run_id) AS latest FROM results")
def latest_run(spark, sf):
    return op.latest_run(results(spark, sf))


@query("mark_flakes", f"{FLAKES} SELECT id, is_flake, total_attempts FROM marked")
def mark_flakes(spark, sf):
    return op.mark_flakes(results(spark, sf)).select("id", "is_flake", "total_attempts")


@query("flake_rate", f"{FLAKES} SELECT nodeid, count(*) AS attempts, count(*) FILTER (outcome = 'failed') AS failures, count(*) FILTER (is_flake) AS flakes, round(count(*) FILTER (is_flake) / count(*), 4) AS flake_rate FROM marked GROUP BY nodeid HAVING count(*) > 1")
def flake_rate(spark, sf):
    return op.flake_rate(results(spark, sf))


@query("run_summary", f"{FLAKES} SELECT run_id, count(*) AS tests, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER ({BAD}) AS failed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (is_flake) AS flaky FROM marked GROUP BY run_id ORDER BY run_id DESC LIMIT 25")
def run_summary(spark, sf):
    return op.run_summary(results(spark, sf))


@query("suite_summary", f"{FINAL} SELECT regexp_extract(nodeid, 'tests/([^/]+)/', 1) AS suite, count(*) AS total, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER ({BAD}) AS failed, count(*) FILTER (outcome = 'skipped') AS skipped FROM final GROUP BY 1")
def suite_summary(spark, sf):
    return op.suite_summary(results(spark, sf))


@query("headline_tiles", f"{FLAKES}, t AS (SELECT count(*) AS attempts, count(*) FILTER ({BAD}) AS failed, count(*) FILTER (is_flake) AS flaky, count(*) FILTER (outcome = 'passed') AS passed FROM marked) SELECT *, round(100.0 * passed / attempts, 4) AS pass_rate, CASE WHEN 100.0 * passed / attempts >= 99 THEN 'good' WHEN 100.0 * passed / attempts >= 90 THEN 'warning' ELSE 'critical' END AS band FROM t")
def headline_tiles(spark, sf):
    return op.headline_tiles(results(spark, sf))


@query("runs_with_results", f"{RESULTS}, runs AS (SELECT DISTINCT run_id FROM results UNION ALL SELECT DISTINCT 1000 + c_nationkey FROM customer) SELECT r.run_id, count(x.id) AS tests, count(x.id) FILTER ({BAD}) AS failed FROM runs r LEFT JOIN results x ON r.run_id = x.run_id GROUP BY r.run_id")
def runs_with_results(spark, sf):
    r = results(spark, sf)
    runs = r.select("run_id").distinct().unionByName(table(spark, sf, "customer").select((F.col("c_nationkey") + 1000).cast("long").alias("run_id")).distinct())
    return op.runs_with_results(runs, r)


@query("recent_failures", f"{FINAL} SELECT id, run_id, nodeid FROM final WHERE {BAD} ORDER BY run_id DESC, id DESC LIMIT 20")
def recent_failures(spark, sf):
    return op.recent_failures(results(spark, sf)).select("id", "run_id", "nodeid")


@query("table_counts", ctes("results", "kpi", "frames") + " SELECT 'results' AS name, count(*) AS n FROM results UNION ALL SELECT 'kpi', count(*) FROM kpi UNION ALL SELECT 'frames', count(*) FROM frames")
def table_counts(spark, sf):
    return op.table_counts(**{n: table(spark, sf, n) for n in ("results", "kpi", "frames")})


@query("suite_from_nodeid", f"{RESULTS} SELECT id, regexp_extract(nodeid, 'tests/([^/]+)/', 1) AS suite FROM results")
def suite_from_nodeid(spark, sf):
    return results(spark, sf).select("id", op.suite_from_nodeid(F.col("nodeid")).alias("suite"))


@query("outcome_from_phase", f"""{RESULTS}, p AS (SELECT id, CASE outcome WHEN 'error' THEN 'failed' ELSE outcome END AS o, id % 5 = 0 AS x, CASE id % 3 WHEN 0 THEN 'setup' WHEN 1 THEN 'call' ELSE 'teardown' END AS phase FROM results)
SELECT id, CASE WHEN o = 'skipped' THEN CASE WHEN x THEN 'xfailed' ELSE 'skipped' END WHEN o = 'passed' THEN CASE WHEN x THEN 'xpassed' ELSE 'passed' END WHEN phase = 'call' THEN 'failed' ELSE 'error' END AS verdict FROM p""")
def outcome_from_phase(spark, sf):
    c = F.col("id")
    phase = F.when(c % 3 == 0, "setup").when(c % 3 == 1, "call").otherwise("teardown")
    return results(spark, sf).select("id", op.outcome_from_phase(F.when(F.col("outcome") == "error", "failed").otherwise(F.col("outcome")), c % 5 == 0, phase).alias("verdict"))


TRACE = "concat('def t():', chr(10), '    x = ', CAST(o_orderkey AS STRING), chr(10), CASE WHEN o_orderkey % 3 = 0 THEN concat('E   assert ', o_orderpriority, chr(10), 'E   second') ELSE o_orderpriority END, chr(10), '  tail ')"


@query("failure_headline", f"""WITH t AS (SELECT o_orderkey, list_filter(string_split({TRACE}, chr(10)), lambda x: trim(x) <> '') AS l FROM orders), m AS (SELECT *, list_filter(l, lambda x: starts_with(ltrim(x), 'E ')) AS e FROM t) SELECT o_orderkey, substring(CASE WHEN len(e) > 0 THEN trim(substring(ltrim(e[1]), 2)) ELSE trim(l[len(l)]) END, 1, 500) AS headline FROM m""")
def failure_headline(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", op.failure_headline(F.expr(TRACE)).alias("headline"))


@query("outcome_pattern", f"{HISTORY} SELECT nodeid, string_agg(CASE WHEN passed THEN '.' ELSE 'F' END, '' ORDER BY run_id) AS pattern FROM (SELECT *, row_number() OVER (PARTITION BY nodeid ORDER BY run_id DESC) AS newest FROM h) WHERE newest <= 40 GROUP BY nodeid")
def outcome_pattern(spark, sf):
    return op.outcome_pattern(results(spark, sf))


RATES = ("pass_rate", "flake_rate", "transition_rate")
R = ", ".join(f"round({x}, 6) AS {x}" for x in RATES)


@query("test_history", f"{HISTORY} SELECT nodeid, runs, transitions, longest_streak, {R} FROM rates")
def test_history(spark, sf):
    return rounded(op.test_history(results(spark, sf)).select("nodeid", "runs", "transitions", "longest_streak", *RATES).withColumn("transitions", F.col("transitions").cast("long")), *RATES)


@query("classify_history", f"{HISTORY} SELECT nodeid, runs, round(flake_rate, 6) AS flake_rate, class, is_flaky FROM classes")
def classify_history(spark, sf):
    return rounded(op.classify_history(results(spark, sf)).select("nodeid", "runs", "flake_rate", "class", "is_flaky"), "flake_rate")


@query("flakiest_tests", f"{HISTORY} SELECT class, nodeid, rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY flake_rate DESC, nodeid) AS rank FROM classes) WHERE rank <= 5")
def flakiest_tests(spark, sf):
    return op.flakiest_tests(results(spark, sf)).select("class", "nodeid", F.col("rank").cast("long"))


TRUTH = "SELECT nodeid, CASE WHEN TRY_CAST(regexp_extract(nodeid, 't([0-9]+)$', 1) AS INT) < 35 THEN TRY_CAST(regexp_extract(nodeid, 't([0-9]+)$', 1) AS INT) >= 20 END AS truth FROM (SELECT DISTINCT nodeid FROM results)"


def truth(spark, sf):
    return spark.sql(TRUTH.replace("FROM results", "FROM {r}"), r=results(spark, sf))


@query("labelled_intersection", f"{HISTORY}, truth AS ({TRUTH}) SELECT nodeid, is_flaky, truth FROM classes JOIN truth USING (nodeid) WHERE truth IS NOT NULL AND runs >= 2")
def labelled_intersection(spark, sf):
    return op.labelled_intersection(op.classified(op.test_history(results(spark, sf))), truth(spark, sf)).select("nodeid", "is_flaky", "truth")


@query("flake_histories_labelled", f"{HISTORY}, truth AS ({TRUTH}) SELECT nodeid, runs, class, truth FROM classes JOIN truth USING (nodeid) WHERE truth IS NOT NULL AND runs >= 2")
def flake_histories_labelled(spark, sf):
    return op.flake_histories_labelled(op.history_rows(results(spark, sf)), "nodeid", "run_id", truth(spark, sf)).select("nodeid", "runs", "class", "truth")


@query("detector_scores", f"{HISTORY}, truth AS ({TRUTH}), s AS (SELECT count(*) FILTER (is_flaky AND truth) AS tp, count(*) FILTER (is_flaky AND NOT truth) AS fp, count(*) FILTER (NOT is_flaky AND truth) AS fn FROM classes JOIN truth USING (nodeid) WHERE truth IS NOT NULL) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM s")
def detector_scores(spark, sf):
    own = op.labelled_intersection(op.classified(op.test_history(results(spark, sf))), truth(spark, sf))
    return rounded(op.detector_scores(own), "precision", "recall")


@query("upsert_latest", f"{RESULTS}, old AS (SELECT * FROM results WHERE id % 3 <> 0), new AS (SELECT id, run_id, nodeid, attempt, 'rerun' AS outcome FROM results WHERE id % 2 = 0) SELECT run_id, nodeid, attempt, coalesce(n.outcome, o.outcome) AS outcome FROM old o FULL JOIN new n USING (run_id, nodeid, attempt)")
def upsert_latest(spark, sf):
    r = results(spark, sf).select("id", "run_id", "nodeid", "attempt", "outcome")
    return op.upsert_latest(r.where("id % 3 <> 0"), r.where("id % 2 = 0").withColumn("outcome", F.lit("rerun")), ["run_id", "nodeid", "attempt"], "id").select("run_id", "nodeid", "attempt", "outcome")


@query("upsert_version", f"{RESULTS}, old AS (SELECT * FROM results WHERE id % 3 <> 0), new AS (SELECT id, run_id, nodeid, attempt, 'rerun' AS outcome FROM results WHERE id % 2 = 0) SELECT run_id, nodeid, attempt, coalesce(n.outcome, o.outcome) AS outcome FROM old o FULL JOIN new n USING (run_id, nodeid, attempt)")
def upsert_version(spark, sf):
    """The same change to a stored table of a partition for each ten runs."""
    r, at, part = results(spark, sf).select("id", "run_id", "nodeid", "attempt", "outcome"), scratch(spark, "versions"), F.floor(F.col("run_id") / 10)
    ver.put_partitions(r.where("id % 3 <> 0"), at, part, set())
    ver.upsert_version(spark, at, r.where("id % 2 = 0").withColumn("outcome", F.lit("rerun")), ["run_id", "nodeid", "attempt"], "id", part)
    return ver.read_version(spark, at, r.schema).select("run_id", "nodeid", "attempt", "outcome")


@query("upsert_templates", "WITH base AS (SELECT event_type AS template, count(*) AS hit_count, min(event_id) AS first_seen, max(event_id) AS last_seen FROM events WHERE event_id % 2 = 0 GROUP BY 1), hits AS (SELECT event_type AS template, 1 AS hit_count, event_id AS first_seen, event_id AS last_seen FROM events WHERE event_id % 2 = 1) SELECT template, CAST(sum(hit_count) AS BIGINT) AS hit_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM (SELECT * FROM base UNION ALL SELECT * FROM hits) GROUP BY template")
def upsert_templates(spark, sf):
    e = table(spark, sf, "events")
    base = e.where("event_id % 2 = 0").groupBy(F.col("event_type").alias("template")).agg(F.count("*").alias("hit_count"), F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"))
    return op.upsert_templates(base, e.where("event_id % 2 = 1").select(F.col("event_type").alias("template"), F.col("event_id").alias("seen")))


@query("insert_ignore", f"{RESULTS}, m AS (SELECT id, run_id, concat_ws('/', CAST(run_id % 4 AS VARCHAR), nodeid) AS member FROM results) SELECT member, min(id) AS id FROM m WHERE run_id % 2 = 0 AND member NOT IN (SELECT member FROM m WHERE run_id % 3 = 0 AND member < '2/tests/p') GROUP BY member")
def insert_ignore(spark, sf):
    r = results(spark, sf).select("id", "run_id", F.concat_ws("/", F.col("run_id") % 4, "nodeid").alias("member"))
    return op.insert_ignore(r.where("run_id % 3 = 0 and member < '2/tests/p'"), r.where("run_id % 2 = 0").select("member", "id"), ["member"], "id")


@query("close_run", f"{RESULTS}, runs AS (SELECT run_id, max(id) AS finished_at, CAST(NULL AS INT) AS exit_status FROM results GROUP BY run_id) SELECT run_id, CASE WHEN run_id % 4 = 0 THEN run_id * 10 ELSE finished_at END AS finished_at, CASE WHEN run_id % 4 = 0 THEN 1 ELSE exit_status END AS exit_status FROM runs")
def close_run(spark, sf):
    runs = results(spark, sf).groupBy("run_id").agg(F.max("id").alias("finished_at")).withColumn("exit_status", F.lit(None).cast("int"))
    return op.close_run(runs, runs.where("run_id % 4 = 0").select("run_id", (F.col("run_id") * 10).alias("finished_at"), F.lit(1).alias("exit_status")))


@query("delete_run_cascade", ctes("results", "kpi") + ", left_r AS (SELECT * FROM results WHERE run_id % 7 <> 0), left_k AS (SELECT k.id, CASE WHEN r.id IS NOT NULL THEN k.id END AS result_id FROM kpi k LEFT JOIN left_r r ON k.id = r.id WHERE k.run_id % 7 <> 0) SELECT 'results' AS name, id, CAST(NULL AS BIGINT) AS result_id FROM left_r UNION ALL SELECT 'kpi', id, result_id FROM left_k")
def delete_run_cascade(spark, sf):
    r, k = results(spark, sf), table(spark, sf, "kpi").withColumn("result_id", F.col("id"))
    gone = r.select("run_id").unionByName(k.select("run_id")).distinct().where("run_id % 7 = 0")
    left = op.delete_run_cascade(gone, {"results": r}, {"kpi": (k, "result_id")})
    return left["results"].select(F.lit("results").alias("name"), "id", F.lit(None).cast("long").alias("result_id")).unionByName(left["kpi"].select(F.lit("kpi").alias("name"), "id", "result_id"))


@query("triage_with_tests", f"{RESULTS}, reports AS (SELECT event_id AS result_id, user_id, event_id % 997 AS created_at FROM events), l AS (SELECT * FROM reports ORDER BY created_at DESC, result_id DESC LIMIT 15) SELECT l.result_id, l.user_id, r.nodeid FROM l LEFT JOIN results r ON r.id = l.result_id")
def triage_with_tests(spark, sf):
    reports = table(spark, sf, "events").select(F.col("event_id").alias("result_id"), "user_id", (F.col("event_id") % 997).alias("created_at"))
    return op.triage_with_tests(reports, results(spark, sf)).select("result_id", "user_id", "nodeid")


NEEDS = "SELECT DISTINCT nodeid, CASE WHEN run_id % 2 = 0 THEN 'sim' ELSE 'radio' END AS backend, CASE run_id % 3 WHEN 0 THEN 'reconfigure' WHEN 1 THEN 'capture' ELSE 'inject' END AS capability FROM results"


@query("capability_gaps", f"{RESULTS}, needs AS ({NEEDS}) SELECT nodeid, backend, 'backend lacks: ' || string_agg(capability, ', ' ORDER BY capability) AS skip_reason FROM needs WHERE (backend, capability) NOT IN (('sim', 'reconfigure'), ('sim', 'inject'), ('radio', 'capture')) GROUP BY nodeid, backend")
def capability_gaps(spark, sf):
    needs = spark.sql(NEEDS.replace("FROM results", "FROM {r}"), r=results(spark, sf))
    tests = needs.groupBy("nodeid", "backend").agg(F.collect_list("capability").alias("required"))
    return op.capability_gaps(tests, spark.createDataFrame([("sim", "reconfigure"), ("sim", "inject"), ("radio", "capture")], "backend string, capability string"))


@query("inapplicable_pairs", "WITH pairs AS (SELECT event_id, 's' || (user_id % 3) AS scenario, 'f' || (event_id % 4) AS fault FROM events) SELECT * FROM pairs WHERE (scenario, fault) NOT IN (('s0', 'f1'), ('s2', 'f3'))")
def inapplicable_pairs(spark, sf):
    pairs = table(spark, sf, "events").select("event_id", F.concat(F.lit("s"), F.col("user_id") % 3).alias("scenario"), F.concat(F.lit("f"), F.col("event_id") % 4).alias("fault"))
    return op.inapplicable_pairs(pairs, spark.createDataFrame([("s0", "f1"), ("s2", "f3")], "scenario string, fault string"))


DIMENSIONS = {"band": ("2.4GHz", "5GHz", "6GHz"), "width": (20, 40, 80, 160, 320), "security": ("open", "wpa2_psk", "wpa3_sae", "wpa2_enterprise"), "phy": ("11n", "11ac", "11ax", "11be")}
#: The configuration that an event was seen with.
SEEN = "CASE user_id % 3 WHEN 0 THEN '2.4GHz' WHEN 1 THEN '5GHz' ELSE '6GHz' END || '-' || CASE event_id % 5 WHEN 0 THEN 20 WHEN 1 THEN 40 WHEN 2 THEN 80 WHEN 3 THEN 160 ELSE 320 END || '-' || CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'wpa2_psk' WHEN 2 THEN 'wpa3_sae' ELSE 'wpa2_enterprise' END || '-' || CASE (event_id + user_id) % 7 WHEN 0 THEN '11n' WHEN 1 THEN '11ac' ELSE '11ax' END"
MATRIX = "WITH " + ", ".join(f"d_{n} AS (SELECT unnest([{', '.join(map(repr, v))}]) AS {n})" for n, v in DIMENSIONS.items()) + """, m AS (SELECT *, concat_ws('-', band, CAST(width AS VARCHAR), security, phy) AS config_id, CASE
WHEN NOT CASE band WHEN '2.4GHz' THEN width IN (20, 40) WHEN '5GHz' THEN width IN (20, 40, 80, 160) ELSE width IN (20, 80, 160, 320) END THEN 'width not in band' WHEN phy = '11ac' AND band <> '5GHz' THEN '11ac is 5GHz only' WHEN phy = '11n' AND band = '6GHz' THEN '11n has no 6GHz'
WHEN phy = '11n' AND width > 40 THEN '11n stops at 40MHz' WHEN phy = '11ac' AND width > 160 THEN '11ac stops at 160MHz' WHEN width = 320 AND phy <> '11be' THEN '320MHz needs 11be' WHEN band = '6GHz' AND security IN ('open', 'wpa2_psk') THEN '6GHz needs WPA3' END AS reason FROM d_band, d_width, d_security, d_phy)"""
MATRIX += f", seen AS (SELECT {SEEN} AS config_id, count(*) AS n FROM events GROUP BY 1)"


def matrix(spark):
    dims = [spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, v))).alias(n)) for n, v in DIMENSIONS.items()]
    return op.config_matrix(*dims)


def seen(spark, sf):
    return table(spark, sf, "events").groupBy(F.expr(SEEN.replace("THEN 20 WHEN 1 THEN 40 WHEN 2 THEN 80 WHEN 3 THEN 160 ELSE 320", "THEN '20' WHEN 1 THEN '40' WHEN 2 THEN '80' WHEN 3 THEN '160' ELSE '320'")).alias("config_id")).agg(F.count("*").alias("n"))


@query("config_matrix", f"{MATRIX} SELECT config_id, reason, coalesce(n, 0) AS n FROM m LEFT JOIN seen USING (config_id)")
def config_matrix(spark, sf):
    return matrix(spark).join(seen(spark, sf), "config_id", "left").select("config_id", "reason", F.coalesce("n", F.lit(0)).alias("n"))


@query("untested_configs", f"{MATRIX} SELECT config_id FROM m WHERE reason IS NULL AND config_id NOT IN (SELECT config_id FROM seen)")
def untested_configs(spark, sf):
    return op.untested_configs(matrix(spark), seen(spark, sf)).select("config_id")


@query("fault_distribution", f"{RESULTS} SELECT 'f' || (id % 6) AS fault, count(DISTINCT run_id) AS runs FROM results WHERE id % 6 > 0 GROUP BY 1")
def fault_distribution(spark, sf):
    return faults(results(spark, sf)).where("fault <> 'f0'").groupBy("fault").agg(F.countDistinct("run_id").alias("runs")).orderBy(F.desc("runs"), "fault")


def faults(r):
    return r.withColumn("fault", F.concat(F.lit("f"), F.col("id") % 6))


@query("only_failures", f"{RESULTS} SELECT id, 'f' || (id % 6) AS fault FROM results WHERE 'f' || (id % 6) <> 'f0'")
def only_failures(spark, sf):
    return faults(results(spark, sf)).where("fault <> 'f0'").select("id", "fault")


@query("fire_rate", f"{RESULTS} SELECT 'f' || (id % 6) AS fault, round(avg(CASE WHEN {BAD} THEN 1.0 ELSE 0.0 END), 6) AS fire_rate FROM results GROUP BY 1")
def fire_rate(spark, sf):
    fired = F.col("outcome").isin("failed", "error")
    return faults(results(spark, sf)).groupBy("fault").agg(F.round(F.avg(fired.cast("double")), 6).alias("fire_rate"))
