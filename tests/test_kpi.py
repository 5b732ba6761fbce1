"""KPI operators on literal samples."""

import pytest
from pyspark.sql import functions as F

from wavelake.functions import kpi as f
from wavelake.operators import kpi as op

SCHEMA = "id long, run_id long, network string, band string, endpoint_name string, probe string, value double, unit string, ok boolean"


def samples(spark, values, probe="dns", start=0, run=1):
    return spark.createDataFrame([(start + i, run, "n", "5GHz", "e", probe, float(v), f"{'mbps' if probe == 'throughput' else 'ms'}", True) for i, v in enumerate(values)], SCHEMA)


def test_series_summary(spark):
    (r,) = op.series_summary(samples(spark, [20, 21, 19, 22, 20, 2000]), "probe").collect()
    assert (r.median, r.mad, r.p95) == (20.5, 1.0, 1505.5)
    assert (round(r["mean"], 2), round(r.stddev, 2)) == (350.33, 737.75)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = lambda *x: [F.lit(float(v)) for v in x]
    assert one(f.modified_z(*lit(30, 20, 0))) == 5.0 and one(f.modified_z(*lit(0, 0, 0))) == 0.0
    assert [one(f.packet_loss_pct(*lit(*x))) for x in ((10, 10), (10, 9), (10, 0), (0, 0))] == [0, 10, 100, 0]
    mos = [one(f.mos_estimate(*lit(*x))) for x in ((20, 2, 0), (45, 8, 0.5), (120, 30, 2), (300, 60, 8))]
    assert mos == sorted(mos, reverse=True) and all(1 <= m <= 5 for m in mos)
    five = F.array(*lit(1, 2, 3, 4, 5))
    assert [one(f.quantile(five, p)) for p in (0, 0.25, 0.5, 1)] == [1, 2, 3, 5]


def test_jitter(spark):
    (r,) = op.jitter_rfc3550(samples(spark, [20, 90, 15, 120, 25]), "id", "probe").collect()
    assert r.jitter == pytest.approx(19.814605712890625)
    (r,) = op.jitter_rfc3550(samples(spark, [20]), "id", "probe").collect()
    assert r.jitter == 0.0


def judged(spark, median, mad, probe, values, n=20):
    rows = [(float(v), probe, float(median), float(mad), n) for v in values]
    df = spark.createDataFrame(rows, "value double, probe string, median double, mad double, n long")
    return [(r.verdict, r.z) for r in op.verdicts(df).collect()]


def test_verdicts(spark):
    assert [v for v, _ in judged(spark, 20, 1, "dns", [20, 22, 200])] == ["ok", "ok", "critical"]
    assert judged(spark, 20, 1, "dns", [4])[0][0] in ("improved", "ok")
    got = judged(spark, 36, 18, "throughput", [4, 180, 16, 7.5])
    assert got[0][0] == "critical" and abs(got[0][1]) < 3.5
    assert got[1][0] == "improved" and got[2][0] not in ("warning", "critical") and got[3][0] == "critical"
    assert judged(spark, 20, 1, "dns", [99], n=3)[0][0] == "insufficient_data"
    assert judged(spark, 0, 0, "loss", [50])[0][0] == "ok"  # a baseline of zero never alerts


def test_end_to_end(spark):
    dns, fast = [20, 21, 20, 19, 22, 20, 21, 20, 19, 23, 20, 21, 20][1:], [36, 70, 18, 45, 22, 88, 30, 55, 12, 40, 62, 25]
    past = samples(spark, dns).unionByName(samples(spark, fast, "throughput", 100))
    base = op.baselines(past)
    noisy = {r.scope_key.split("|")[3]: r.noisy for r in base.collect()}
    assert noisy == {"dns": False, "throughput": True}
    now = samples(spark, [400], start=200).unionByName(samples(spark, [4], "throughput", 201)).unionByName(samples(spark, [9999], "jitter", 202))
    assert {r.probe: r.verdict for r in op.detect_regressions(now, base).collect()} == {"dns": "critical", "throughput": "critical", "jitter": "no_baseline"}
    assert {r.verdict for r in op.detect_regressions(now, base).collect()} == {r.verdict for r in op.verdicts(op.kpi_vs_baseline(now, base, most=0)).collect()}


def test_baselines_need_eight(spark):
    assert op.baselines(samples(spark, range(7))).count() == 0
    two = samples(spark, [20] * 10).unionByName(samples(spark, [60] * 10, start=50).withColumn("band", F.lit("2.4GHz")))
    assert sorted(r.median for r in op.baselines(two).collect()) == [20.0, 60.0]


def test_common_features(spark):
    cells = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 2.0)], "run_id long, feature string, value double")
    assert [r.feature for r in op.common_features(cells).collect()] == ["a"]
    apart = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "run_id long, feature string, value double")
    assert op.common_features(apart).count() == 0


def test_quantiles_of_groups_of_any_size(spark):
    """By ranks and by an aggregate: bit-equal; nulls, repeats, one value, no value, null keys."""
    import random

    from pyspark.sql import functions as F

    from wavelake.operators import selection as se

    rnd = random.Random(4)
    rows = [(k, rnd.choice([rnd.random() * 1e6, float(rnd.randrange(5)), -1.5])) for k in ("a", "b", None) for _ in range(rnd.randrange(500, 3000))] + [("one", 2.5), ("none", None), ("a", None), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    ps = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    told = lambda x: sorted(map(tuple, x.collect()), key=str)
    held = told(se.held_quantiles(df, ["k"], "v", ps))
    assert [r for r in held if r[0] != "none"] == told(se.ranked_quantiles(df, ["k"], "v", ps))
    assert told(se.quantiles(df, ["k"], "v", ps, held=600)) == held
    big = spark.range(3_000_000).select(F.lit("g").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10_000_019)) / 7).alias("v"))
    assert told(se.ranked_quantiles(big, ["k"], "v", (0.5, 0.99))) == told(se.held_quantiles(big, ["k"], "v", (0.5, 0.99)))


def test_ratios_are_rounded_by_their_exact_value(spark):
    import struct

    # halves go to even, what only looks like a half in its shortest text goes where its bits are
    values = [1747.25, 46.25, 2.75, 2.65, 3.35, 4.05, 9.95, 99.95, 2.5, 2.96, 1e9 + 0.25, 123456789.05, *(struct.unpack("<d", struct.pack("<Q", 0x4004000000000000 + i * 0x9E3779B97F))[0] for i in range(2000))]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", op.one_decimal(F.col("x")).alias("s")).collect()
    assert [(r.x, r.s) for r in got if r.s != f"{r.x:.1f}"] == []
    assert spark.createDataFrame([(float("inf"),)], "x double").select(op.one_decimal(F.col("x")).alias("s")).first().s == "inf"


def test_queries_round_as_their_sql_does(spark):
    import duckdb

    from wavelake.plans.kpi import rounded

    values = [0.6745 * (100.1 - 35.28) / 21.28, -0.6745 * (100.1 - 35.28) / 21.28, 0.1234565, 2.0000005, 1.0000015, -3.5, 0.0, 1e300, float("inf"), *(0.0000005 + i / 1e6 for i in range(500))]
    got = [r.x for r in rounded(spark.createDataFrame([(x,) for x in values], "x double"), "x").collect()]
    con = duckdb.connect()
    assert got == [con.execute("select round(cast(? as double), 6)", [x]).fetchall()[0][0] for x in values]


def test_medians_have_the_bits_of_their_sql(spark):
    import random

    import duckdb

    from wavelake.functions import kpi as f
    from wavelake.plans.kpi import rounded

    rnd = random.Random(3)
    rows = [(i, sorted(round(rnd.expovariate(1 / 50), 2) for _ in range(rnd.choice([2, 3, 8])))) for i in range(2000)]
    got = dict(spark.createDataFrame(rows, "i long, v array<double>").select("i", f.quantile(F.col("v"), 0.5)).collect())
    con = duckdb.connect()
    con.execute("create table t (i bigint, v double)")
    con.executemany("insert into t values (?, ?)", [(i, x) for i, v in rows for x in v])
    assert got == dict(con.execute("select i, median(v) from t group by i").fetchall())
    values = [65194151025.49909, -65194151025.49909, 4503599627.370497, 1e200, float("-inf"), *(1e10 + i / 7 for i in range(300))]
    got = [r.x for r in rounded(spark.createDataFrame([(x,) for x in values], "x double"), "x").collect()]
    assert got == [con.execute("select round(cast(? as double), 6)", [x]).fetchall()[0][0] for x in values]
