"""Test attempts: final outcomes, flakes, histories, summaries, and the writes of the store as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAD = ("failed", "error")
#: Classes in order of urgency.
CLASSES = ("regressed", "flaky", "failing", "fixed", "stable")


def suite_from_nodeid(nodeid: Column) -> Column:
    """The directory under tests/, or root."""
    found = F.regexp_extract(nodeid, r"tests/([^/]+)/", 1)
    return F.when(found == "", "root").otherwise(found)


def outcome_from_phase(outcome: Column, was_xfail: Column, phase: Column) -> Column:
    """outcome is passed, failed or skipped; a failure outside the call is an error."""
    return (
        F.when((outcome == "skipped") & was_xfail, "xfailed").when(outcome == "skipped", "skipped")
        .when((outcome == "passed") & was_xfail, "xpassed").when(outcome == "passed", "passed")
        .when(phase == "call", "failed").otherwise("error")
    )


def failure_headline(trace: Column) -> Column:
    """The first line that begins with E and a blank, without that; else the last line; at most 500 characters."""
    lines = F.filter(F.split(trace, "\n"), lambda x: F.trim(x) != "")
    marked = F.get(F.filter(lines, lambda x: F.ltrim(x).startswith("E ")), F.lit(0))
    return F.substring(F.coalesce(F.trim(F.substr(F.ltrim(marked), F.lit(2))), F.trim(F.get(lines, F.size(lines) - 1)), F.lit("")), 1, 500)


def outcome_pattern(results: DataFrame, n: int = 40) -> DataFrame:
    """The last n final outcomes of each test as dots and Fs."""
    rows = history_rows(results).withColumn("newest", F.row_number().over(W.partitionBy("nodeid").orderBy(F.col("run_id").desc()))).where(F.col("newest") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("run_id", "passed")))
    return rows.groupBy("nodeid").agg(F.array_join(F.transform(ordered, lambda x: F.when(x["passed"], ".").otherwise("F")), "").alias("pattern"))


def final_results(results: DataFrame) -> DataFrame:
    """The highest attempt of each test in each run; one shuffle, no self-join."""
    w = W.partitionBy("run_id", "nodeid").orderBy(F.col("attempt").desc())
    return results.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def failed_results(results: DataFrame, run_id: int | None = None) -> DataFrame:
    """Final failures and errors of a run, or of the latest."""
    final = final_results(results).where(F.col("outcome").isin(*BAD))
    run = F.lit(run_id) if run_id is not None else F.col("latest")
    return final.crossJoin(F.broadcast(latest_run(results))).where(F.col("run_id") == run).drop("latest")


def latest_run(results: DataFrame) -> DataFrame:
    return results.agg(F.max("run_id").alias("latest"))


def mark_flakes(results: DataFrame) -> DataFrame:
    """is_flake on all attempts of a test that passed after it had failed, and the number of attempts."""
    w = W.partitionBy("run_id", "nodeid")
    first_bad = F.min(F.when(F.col("outcome").isin(*BAD), F.col("attempt"))).over(w)
    last_good = F.max(F.when(F.col("outcome") == "passed", F.col("attempt"))).over(w)
    return results.withColumns({"is_flake": F.coalesce(first_bad < last_good, F.lit(False)), "total_attempts": F.count("*").over(w)})


def flake_rate(results: DataFrame) -> DataFrame:
    """Of tests with more than one attempt; failures are those of outcome failed alone."""
    out = mark_flakes(results).groupBy("nodeid").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "failed").alias("failures"), F.count_if("is_flake").alias("flakes"))
    return out.where("attempts > 1").withColumn("flake_rate", F.round(F.col("flakes") / F.col("attempts"), 4)).orderBy(F.desc("flake_rate"), F.desc("attempts"), "nodeid")


def run_summary(results: DataFrame, limit: int = 25) -> DataFrame:
    """The newest runs that have tests."""
    c = F.col("outcome")
    rows = mark_flakes(results).groupBy("run_id").agg(F.count("*").alias("tests"), F.count_if(c == "passed").alias("passed"), F.count_if(c.isin(*BAD)).alias("failed"), F.count_if(c == "skipped").alias("skipped"), F.count_if("is_flake").alias("flaky"))
    return rows.where("tests > 0").orderBy(F.desc("run_id")).limit(limit)


def suite_summary(results: DataFrame) -> DataFrame:
    final = final_results(results).withColumn("suite", suite_from_nodeid(F.col("nodeid"))).where("suite is not null")
    c = F.col("outcome")
    return final.groupBy("suite").agg(F.count("*").alias("total"), F.count_if(c == "passed").alias("passed"), F.count_if(c.isin(*BAD)).alias("failed"), F.count_if(c == "skipped").alias("skipped")).orderBy(F.desc("total"), "suite")


def headline_tiles(results: DataFrame) -> DataFrame:
    """Totals, pass rate and its band (99 and 90 percent)."""
    c = F.col("outcome")
    out = mark_flakes(results).agg(F.count("*").alias("attempts"), F.count_if(c.isin(*BAD)).alias("failed"), F.count_if("is_flake").alias("flaky"), F.count_if(c == "passed").alias("passed"))
    rate = 100.0 * F.col("passed") / F.col("attempts")
    return out.withColumn("pass_rate", F.round(rate, 4)).withColumn("band", F.when(rate >= 99, "good").when(rate >= 90, "warning").otherwise("critical"))


def runs_with_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each run with the number of its results, 0 if it has none."""
    own = results.groupBy("run_id").agg(F.count("*").alias("tests"), F.count_if(F.col("outcome").isin(*BAD)).alias("failed"))
    return runs.join(own, "run_id", "left").fillna(0, ["tests", "failed"])


def recent_failures(results: DataFrame, n: int = 20) -> DataFrame:
    return final_results(results).where(F.col("outcome").isin(*BAD)).orderBy(F.desc("run_id"), F.desc("id")).limit(n)


def table_counts(**tables: DataFrame) -> DataFrame:
    """name, n of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def history_rows(results: DataFrame) -> DataFrame:
    """nodeid, run_id, passed of final outcomes that are passed or failed."""
    return final_results(results).where(F.col("outcome").isin("passed", "failed")).select("nodeid", "run_id", (F.col("outcome") == "passed").alias("passed"))


def test_history(results: DataFrame) -> DataFrame:
    return histories(history_rows(results), "nodeid", "run_id")


def histories(rows: DataFrame, key: str, order: str) -> DataFrame:
    """runs, pass and flake rate, transitions, longest streak, first and last outcome of the ordered outcomes (passed) of each key: gaps and islands."""
    w = W.partitionBy(key).orderBy(order)
    changed = rows.withColumn("changed", F.coalesce(F.col("passed") != F.lag("passed").over(w), F.lit(False)).cast("int"))
    islands = changed.withColumn("island", F.sum("changed").over(w.rowsBetween(W.unboundedPreceding, 0)))
    streaks = islands.groupBy(key, "island").agg(F.count("*").alias("n"), F.min("passed").alias("passed"))
    out = streaks.groupBy(key).agg(F.sum("n").alias("runs"), F.sum(F.when(F.col("passed"), F.col("n")).otherwise(0)).alias("passes"), F.max("island").alias("transitions"), F.max("n").alias("longest_streak"), F.min_by("passed", "island").alias("first_passed"), F.max_by("passed", "island").alias("last_passed"), F.max_by("n", "island").alias("last_streak"))
    failures = F.col("runs") - F.col("passes")
    return out.withColumns({
        "pass_rate": F.col("passes") / F.col("runs"), "flake_rate": F.least(F.col("passes"), failures) / F.col("runs"),
        "transition_rate": F.when(F.col("runs") > 1, F.col("transitions") / (F.col("runs") - 1)).otherwise(0.0),
    })


def classified(history: DataFrame, min_obs: int = 4, threshold: float = 0.10) -> DataFrame:
    """class and is_flaky of histories: one change is a fix or a regression, more are flakiness."""
    c = F.col
    often = c("flake_rate") >= threshold
    kind = F.when(c("passes") == c("runs"), "stable").when(c("passes") == 0, "failing").when((c("transitions") >= 2) & often, "flaky").when((c("transitions") == 1) & c("last_passed"), "fixed").when(c("transitions") == 1, "regressed").otherwise("stable")
    flaky = (c("runs") >= min_obs) & (c("flake_rate") >= threshold) & (c("transitions") >= 2)
    return history.withColumns({"class": kind, "is_flaky": flaky})


def classify_history(results: DataFrame, min_obs: int = 4, threshold: float = 0.10) -> DataFrame:
    """Histories with their class, the most urgent first."""
    out = classified(test_history(results), min_obs, threshold)
    return out.withColumn("urgency", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))).orderBy("urgency", F.desc("flake_rate"), "nodeid")


def flakiest_tests(results: DataFrame, n: int = 5) -> DataFrame:
    """The n tests of greatest flake rate of each class."""
    w = W.partitionBy("class").orderBy(F.desc("flake_rate"), "nodeid")
    return classified(test_history(results)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def flake_histories_labelled(outcomes: DataFrame, key: str, order: str, truth: DataFrame) -> DataFrame:
    """Histories (of at least two runs) of made-up tests, with the truth label of each."""
    return labelled_intersection(classified(histories(outcomes, key, order)), truth, key)


def labelled_intersection(history: DataFrame, truth: DataFrame, key: str = "nodeid") -> DataFrame:
    """Histories of at least two runs that have a truth label."""
    return history.where("runs >= 2").join(truth.where("truth is not null").select(key, "truth"), key)


def detector_scores(found: DataFrame) -> DataFrame:
    """True and false positives, false negatives, precision and recall of is_flaky against truth."""
    hit, real = F.col("is_flaky"), F.col("truth")
    out = found.agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(0.0)
    return out.withColumns({"precision": share("fp"), "recall": share("fn")})


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key, the update of greatest order or else the base's; columns in keep are those of the first insert."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    w = W.partitionBy(*keys)
    newest, oldest = w.orderBy(F.desc("_new"), F.desc(order)), w.orderBy("_new", order)
    kept = {c: F.first(c).over(oldest) for c in keep}
    return both.withColumns(kept | {"_rank": F.row_number().over(newest)}).where("_rank = 1").drop("_rank", "_new")


def upsert_templates(base: DataFrame, hits: DataFrame) -> DataFrame:
    """template, hit_count, first_seen, last_seen after one more hit for each row of hits (template, seen)."""
    new = hits.select("template", F.lit(1).cast("long").alias("hit_count"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"))
    return base.unionByName(new).groupBy("template").agg(F.sum("hit_count").alias("hit_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def insert_ignore(base: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of unseen keys, the first in order of each."""
    fresh = rows.join(base.select(*keys).distinct(), keys, "left_anti")
    return fresh.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_rank = 1").drop("_rank")


def close_run(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """runs with finished_at and exit_status of ends (run_id, finished_at, exit_status), where it has them."""
    new = ends.select("run_id", F.col("finished_at").alias("_at"), F.col("exit_status").alias("_status"))
    return runs.join(new, "run_id", "left").withColumns({"finished_at": F.coalesce("_at", "finished_at"), "exit_status": F.coalesce("_status", "exit_status")}).drop("_at", "_status")


def delete_run_cascade(gone: DataFrame, children: dict[str, DataFrame], loose: dict[str, tuple[DataFrame, str]] | None = None, results: str = "results") -> dict[str, DataFrame]:
    """Tables without the rows of the runs in gone (run_id). loose: tables that only lose the reference: column result_id of a deleted result becomes null."""
    left = {name: df.join(gone.select("run_id"), "run_id", "left_anti") for name, df in children.items()}
    for name, (df, column) in (loose or {}).items():
        known = left[results].select(F.col("id").alias("_id"))
        own = df.join(gone.select("run_id"), "run_id", "left_anti") if "run_id" in df.columns else df
        left[name] = own.join(known, own[column] == F.col("_id"), "left").withColumn(column, F.when(F.col("_id").isNotNull(), F.col(column))).drop("_id")
    return left


def triage_with_tests(reports: DataFrame, results: DataFrame, n: int = 15) -> DataFrame:
    """The latest n reports with the nodeid of their result."""
    latest = reports.orderBy(F.desc("created_at"), F.desc("result_id")).limit(n)
    return latest.join(results.select(F.col("id").alias("result_id"), "nodeid"), "result_id", "left")


def capability_gaps(tests: DataFrame, backends: DataFrame) -> DataFrame:
    """tests (nodeid, required: array) whose backend (backend, capability rows) lacks something: a skip reason for each."""
    needs = tests.select("nodeid", "backend", F.explode("required").alias("capability"))
    missing = needs.join(backends, ["backend", "capability"], "left_anti")
    return missing.groupBy("nodeid", "backend").agg(F.concat(F.lit("backend lacks: "), F.array_join(F.array_sort(F.collect_set("capability")), ", ")).alias("skip_reason"))


def inapplicable_pairs(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(scenario, fault) pairs that can fire."""
    return pairs.join(rules, ["scenario", "fault"], "left_anti")


def config_matrix(bands: DataFrame, widths: DataFrame, securities: DataFrame, phys: DataFrame) -> DataFrame:
    """Every combination of four small dimension tables with its id and why it isn't legal (null: it is)."""
    c = F.col
    every = bands  # a few rows each: the product is fixed
    for d in (widths, securities, phys):
        every = every.crossJoin(F.broadcast(d))
    allowed = F.when(c("band") == "2.4GHz", c("width").isin(20, 40)).when(c("band") == "5GHz", c("width").isin(20, 40, 80, 160)).otherwise(c("width").isin(20, 80, 160, 320))
    reason = (
        F.when(~allowed, "width not in band")
        .when((c("phy") == "11ac") & (c("band") != "5GHz"), "11ac is 5GHz only")
        .when((c("phy") == "11n") & (c("band") == "6GHz"), "11n has no 6GHz")
        .when((c("phy") == "11n") & (c("width") > 40), "11n stops at 40MHz")
        .when((c("phy") == "11ac") & (c("width") > 160), "11ac stops at 160MHz")
        .when((c("width") == 320) & (c("phy") != "11be"), "320MHz needs 11be")
        .when((c("band") == "6GHz") & c("security").isin("open", "wpa2_psk"), "6GHz needs WPA3")
    )
    return every.withColumns({"config_id": F.concat_ws("-", "band", F.col("width").cast("string"), "security", "phy"), "reason": reason})


def untested_configs(matrix: DataFrame, tested: DataFrame) -> DataFrame:
    """Legal configurations without a result (tested: config_id)."""
    return matrix.where("reason is null").join(tested.select("config_id").distinct(), "config_id", "left_anti")
