"""Test attempts on literal histories."""

from pyspark.sql import functions as F

from wavelake.operators import learning, results as op


def attempts(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, run_id long, nodeid string, attempt int, outcome string")


def history(spark, **patterns):
    return attempts(spark, *((run, name, 1, "passed" if x == "." else "failed") for name, p in patterns.items() for run, x in enumerate(p)))


def test_final_and_flakes(spark):
    r = attempts(spark, (1, "a", 1, "failed"), (1, "a", 2, "failed"), (1, "a", 3, "passed"), (1, "b", 1, "passed"), (1, "b", 2, "error"))
    assert {x.nodeid: (x.attempt, x.outcome) for x in op.final_results(r).collect()} == {"a": (3, "passed"), "b": (2, "error")}
    assert {x.nodeid: x.is_flake for x in op.mark_flakes(r).collect()} == {"a": True, "b": False}


def test_classes(spark):
    got = op.classify_history(history(spark, a=".F.F.F.F", b="FFFF....", c="....FFFF", d="FFFFFFFF", e="........", f=".F.")).collect()
    assert {r.nodeid: r["class"] for r in got} == {"a": "flaky", "b": "fixed", "c": "regressed", "d": "failing", "e": "stable", "f": "flaky"}
    assert {r.nodeid for r in got if r.is_flaky} == {"a"}
    assert {r.nodeid: (r.flake_rate, r.transitions) for r in got if r.nodeid in "ab"} == {"a": (0.5, 7), "b": (0.5, 1)}


def test_cascade(spark):
    runs = spark.createDataFrame([(1,)], "run_id long")
    r = attempts(spark, (1, "a", 1, "failed"), (2, "a", 1, "failed"))
    reports = spark.createDataFrame([(10, 1, 0), (11, 2, 1), (12, 2, 0)], "rid long, run_id long, result_id long")
    left = op.delete_run_cascade(runs, {"results": r}, {"reports": (reports, "result_id")})
    assert [x.id for x in left["results"].collect()] == [1]
    assert {x.rid: x.result_id for x in left["reports"].collect()} == {11: 1, 12: None}


def test_headline(spark):
    df = spark.createDataFrame([("a\nE   assert x\nE  y\nlast",), ("only\nlast ",), ("",)], "t string")
    assert [r[0] for r in df.select(op.failure_headline(F.col("t"))).collect()] == ["assert x", "last", ""]


def test_upsert_keeps_first_columns(spark):
    base = spark.createDataFrame([(1, "a", "old", "s0")], "id long, k string, v string, suite string")
    new = spark.createDataFrame([(2, "a", "new", "s1"), (3, "b", "x", "s2")], base.schema)
    got = {r.k: (r.v, r.suite) for r in op.upsert_latest(base, new, ["k"], "id", ("suite",)).collect()}
    assert got == {"a": ("new", "s0"), "b": ("x", "s2")}


def test_insert_ignore_keeps_the_first(spark):
    rows = spark.createDataFrame([(3, "a", "late"), (1, "a", "first"), (2, "b", "known")], "id long, k string, v string").repartition(3)
    assert [tuple(r) for r in op.insert_ignore(rows.where("k = 'b'"), rows, ["k"], "id").collect()] == [("a", 1, "first")]


def test_numbers_follow_the_order(spark):
    from wavelake.session import numbered

    rows = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "x int").repartition(7)
    assert [(r.x, r.n) for r in numbered(rows, "x", "n").orderBy("x").collect()] == [(i, i) for i in range(1000)]
    assert numbered(rows.limit(0), "x", "n").count() == 0


def test_flake_classifier(spark):
    patterns = {f"f{i}": ".F" * 4 + "." * (i % 3) for i in range(12)} | {f"s{i}": "." * (8 + i % 3) for i in range(12)}
    h = op.classified(op.test_history(history(spark, **patterns)))
    truth = spark.createDataFrame([(k, k[0] == "f") for k in patterns], "nodeid string, truth boolean")
    got = learning.flake_classifier(h, truth, trees=20).collect()
    assert all(r.predicted == r.truth for r in got) and got[0].f1 == 1.0
    assert {x.feature for x in got[0].importances} == set(learning.HISTORY) and abs(sum(x.importance for x in got[0].importances) - 1) < 1e-6
    assert learning.flake_classifier(h, truth.where("truth"), trees=5) is None
    assert learning.flake_classifier(h, truth.limit(1), trees=5) is None


def test_isolation_forest(spark):
    rows = [(i, 20.0 + i % 5, 30.0 + i % 7, 0.1 * (i % 3)) for i in range(60)] + [(60, 900.0, 800.0, 0.5)]
    cells = spark.createDataFrame([(r[0], f"f{j}", v) for r in rows for j, v in enumerate(r[1:])], "run_id long, feature string, value double")
    first, again = (sorted((r.run_id, r.score, r.is_anomaly) for r in learning.isolation_forest(cells, trees=40).collect()) for _ in range(2))
    assert first == again and max(first, key=lambda r: r[1])[0] == 60 and dict((r[0], r[2]) for r in first)[60]
    assert not any(r.trained for r in learning.isolation_forest(cells.where("run_id < 19")).collect())
