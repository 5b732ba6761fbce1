"""Queries over KPI samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kpi as f
from ..operators import kpi as op
from .fixtures import ctes, table
from .registry import query

KPI = ctes("kpi")
KEY = "concat_ws('|', coalesce(network, ''), coalesce(band, ''), coalesce(endpoint_name, ''), coalesce(probe, ''))"
Z = "CASE WHEN mad = 0 THEN CASE WHEN median = 0 THEN 0.0 ELSE 10.0 * (value - median) / abs(median) END ELSE 0.6745 * (value - median) / mad END"
BASELINES = f"""{KPI}, newest AS (SELECT * FROM (SELECT *, {KEY} AS scope_key, row_number() OVER (PARTITION BY {KEY} ORDER BY id DESC) AS rank FROM kpi WHERE ok AND value IS NOT NULL) WHERE rank <= 200),
mid AS (SELECT *, median(value) OVER (PARTITION BY scope_key) AS m FROM newest),
stats AS (SELECT scope_key, count(*) AS n, median(value) AS median, median(abs(value - m)) AS mad, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, min(value) AS min_value, max(value) AS max_value, CASE min(probe) WHEN 'throughput' THEN 'mbps' WHEN 'loss' THEN 'pct' ELSE 'ms' END AS unit FROM mid GROUP BY scope_key HAVING count(*) >= 8),
baselines AS (SELECT *, median + 3.5 * 1.4826 * mad AS upper_bound, median - 3.5 * 1.4826 * mad AS lower_bound, CASE WHEN median = 0 THEN 0.0 ELSE mad / median END AS relative_mad, CASE WHEN median = 0 THEN false ELSE mad / median > 0.35 END AS noisy, median = 0 AS zero_median FROM stats)"""
REGRESSIONS = f"""{BASELINES}, joined AS (SELECT k.id, k.run_id, k.probe, k.value, {KEY} AS scope_key, b.n, b.median, b.mad, b.noisy FROM kpi k LEFT JOIN baselines b ON {KEY} = b.scope_key WHERE k.ok AND k.value IS NOT NULL),
judged AS (SELECT *, {Z} AS z, CASE WHEN median = 0 THEN 0.0 ELSE abs(value - median) / median END AS relative, probe IN {f.HIGHER_IS_WORSE} AS up, probe IN ('throughput') AS down FROM joined),
ratios AS (SELECT *, (z > 0 AND up) OR (z < 0 AND down) AS got_worse, CASE WHEN median > 0 AND up THEN value / median WHEN median > 0 AND down AND value > 0 THEN median / value WHEN median > 0 AND down THEN CAST('inf' AS DOUBLE) ELSE 1.0 END AS ratio,
 CASE WHEN median > 0 AND down THEN value / median WHEN median > 0 AND up AND value > 0 THEN median / value ELSE 0.0 END AS inverse FROM judged),
found AS (SELECT *, CASE WHEN n IS NULL THEN 'no_baseline' WHEN n < 8 THEN 'insufficient_data' WHEN relative < 0.25 THEN 'ok' WHEN NOT got_worse AND (abs(z) > 3.5 OR inverse >= 2.5) THEN 'improved' WHEN got_worse AND (abs(z) >= 7 OR ratio >= 4) THEN 'critical' WHEN got_worse AND (abs(z) >= 3.5 OR ratio >= 2.5) THEN 'warning' ELSE 'ok' END AS verdict FROM ratios)"""


def as_sql_rounds(x, digits):
    """round() as DuckDB has it: of the product with a power of ten as a double, half away from zero. Spark's rounds the shortest text of a number, which differs where one of them is at a half."""
    at = F.abs(x * F.lit(10.0**digits))
    whole = F.floor(at)
    # from 2**52 on the product is whole, and dividing it gives other bits than x has
    near = F.when(at < 2.0**52, (whole + F.when(at - whole >= 0.5, 1).otherwise(0)).cast("double")).otherwise(at) / F.lit(10.0**digits)
    return F.when(at < float("inf"), F.when(x < 0, -near).otherwise(near)).otherwise(x)


def rounded(df, *columns, digits=6):
    return df.withColumns({c: as_sql_rounds(F.col(c), digits) for c in columns})


def r(*columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query("kpi_scope_filter", f"{KPI} SELECT id, run_id, value FROM kpi WHERE ok AND value IS NOT NULL AND band = '5GHz' AND probe = 'dns'")
def kpi_scope_filter(spark, sf):
    return op.kpi_scope_filter(table(spark, sf, "kpi"), band="5GHz", probe="dns").select("id", "run_id", "value")


@query("distinct_scopes", f"{KPI} SELECT DISTINCT network, band, endpoint_name, probe FROM kpi WHERE ok AND value IS NOT NULL")
def distinct_scopes(spark, sf):
    return op.distinct_scopes(table(spark, sf, "kpi"))


@query("newest_n_per_scope", f"{BASELINES} SELECT scope_key, id, value FROM newest")
def newest_n_per_scope(spark, sf):
    return op.newest_n_per_scope(table(spark, sf, "kpi")).select("scope_key", "id", "value")


@query("scope_key", f"{KPI} SELECT id, {KEY} AS scope_key, network AS part_0, probe AS part_3, '' AS part_4 FROM kpi")
def scope_key(spark, sf):
    k = table(spark, sf, "kpi").withColumn("scope_key", f.scope_key())
    return k.select("id", "scope_key", f.scope_part(F.col("scope_key"), 0).alias("part_0"), f.scope_part(F.col("scope_key"), 3).alias("part_3"), f.scope_part(F.col("scope_key"), 4).alias("part_4"))


SUMMARY = "count(value) AS n, round(median(value), 6) AS median, round(median(abs(value - m)), 6) AS mad, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS min_value, max(value) AS max_value, round(1.4826 * median(abs(value - m)), 6) AS jitter, round(CASE WHEN median(value) <> 0 THEN quantile_cont(value, 0.99) / median(value) END, 6) AS tail_ratio"
PARTS = ("median", "mad", "mean", "stddev", "p95", "p99", "jitter", "tail_ratio")


@query("series_summary", f"{KPI}, mid AS (SELECT *, median(value) OVER (PARTITION BY endpoint_name, probe) AS m FROM kpi WHERE ok AND value IS NOT NULL) SELECT endpoint_name, probe, {SUMMARY} FROM mid GROUP BY ALL")
def series_summary(spark, sf):
    return rounded(op.series_summary(op.usable(table(spark, sf, "kpi")), "endpoint_name", "probe"), *PARTS)


@query("probe_summary", f"{KPI}, mid AS (SELECT *, median(value) OVER (PARTITION BY run_id, probe) AS m FROM kpi WHERE ok AND value IS NOT NULL AND unit = 'ms') SELECT run_id, probe, {SUMMARY} FROM mid GROUP BY ALL")
def probe_summary(spark, sf):
    return rounded(op.probe_summary(table(spark, sf, "kpi")), *PARTS)


def mos_sql(rtt, jitter, loss):
    lat = f"({rtt} + 2 * {jitter} + 10.0)"
    score = f"greatest(0.0, least(100.0, CASE WHEN {lat} < 160 THEN 93.2 - {lat} / 40.0 ELSE 93.2 - ({lat} - 120) / 10.0 END - 2.5 * {loss}))"
    return f"(SELECT greatest(1.0, least(5.0, 1 + 0.035 * x + x * (x - 60) * (100 - x) * 7e-6)) FROM (SELECT CAST({score} AS DOUBLE) AS x))"


CLASS = "CASE WHEN mos >= 4.3 THEN 'excellent' WHEN mos >= 4.0 THEN 'good' WHEN mos >= 3.6 THEN 'fair' WHEN mos >= 3.1 THEN 'poor' ELSE 'unacceptable' END"


@query("call_quality", f"""{KPI}, best AS (SELECT run_id, min(value) FILTER (probe = 'icmp_rtt' AND value > 0) AS rtt, coalesce(min(value) FILTER (probe = 'jitter' AND value > 0), 0.0) AS jitter, coalesce(min(value) FILTER (probe = 'loss'), 0.0) AS loss FROM kpi WHERE ok AND value IS NOT NULL GROUP BY run_id),
m AS (SELECT *, {mos_sql('rtt', 'jitter', 'loss')} AS mos FROM best WHERE rtt IS NOT NULL) SELECT run_id, rtt, jitter, loss, round(mos, 6) AS mos, {CLASS} AS quality FROM m""")
def call_quality(spark, sf):
    return rounded(op.call_quality(table(spark, sf, "kpi")), "mos")


@query("mos_estimate", f"SELECT event_id, round({mos_sql('value', 'CAST(event_id % 50 AS DOUBLE)', 'CAST(event_id % 7 AS DOUBLE)')}, 6) AS mos FROM events")
def mos_estimate(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.round(f.mos_estimate(F.col("value"), (F.col("event_id") % 50).cast("double"), (F.col("event_id") % 7).cast("double")), 6).alias("mos"))


@query("classify_mos", f"WITH e AS (SELECT event_id, 1 + (event_id % 401) / 100 AS mos FROM events) SELECT event_id, {CLASS} AS quality FROM e")
def classify_mos(spark, sf):
    return table(spark, sf, "events").select("event_id", f.classify_mos(1 + (F.col("event_id") % 401) / 100).alias("quality"))


@query("packet_loss_pct", "SELECT event_id, round(CASE WHEN event_id % 11 <= 0 THEN 0.0 ELSE 100.0 * (event_id % 11 - least(event_id % 11, event_id % 13)) / (event_id % 11) END, 6) AS loss_pct FROM events")
def packet_loss_pct(spark, sf):
    sent = F.col("event_id") % 11
    return table(spark, sf, "events").select("event_id", F.round(f.packet_loss_pct(sent, F.least(sent, F.col("event_id") % 13)), 6).alias("loss_pct"))


@query("modified_z", f"WITH e AS (SELECT event_id, value, CAST(event_id % 90 AS DOUBLE) AS median, CAST(event_id % 4 AS DOUBLE) AS mad FROM events) SELECT event_id, round({Z}, 8) AS z FROM e")
def modified_z(spark, sf):
    c = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.round(f.modified_z(F.col("value"), (c % 90).cast("double"), (c % 4).cast("double")), 8).alias("z"))


@query("baselines", f"{BASELINES} SELECT scope_key, n, {r('median', 'mad', 'p95', 'p99')}, min_value, max_value, unit, {r('upper_bound', 'lower_bound', 'relative_mad', digits=8)}, noisy, zero_median FROM baselines")
def baselines(spark, sf):
    return rounded(rounded(op.baselines(table(spark, sf, "kpi")), "median", "mad", "p95", "p99"), "upper_bound", "lower_bound", "relative_mad", digits=8)


def two(x: str) -> str:
    """A number with two decimals."""
    return f"CAST(CAST(round(CAST(CAST(round({x}, 6) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DECIMAL(38, 2)) AS VARCHAR)"


@query("kpi_vs_baseline", f"{REGRESSIONS} SELECT id, scope_key, value, n, {r('median', 'mad')} FROM joined")
def kpi_vs_baseline(spark, sf):
    k = table(spark, sf, "kpi")
    return rounded(op.kpi_vs_baseline(k, op.baselines(k)).select("id", "scope_key", "value", "n", "median", "mad"), "median", "mad")


@query("detect_regressions", f"{REGRESSIONS} SELECT id, run_id, scope_key, value, {r('z', 'relative', 'ratio')}, noisy, verdict, concat_ws(', ', CASE WHEN n IS NULL THEN {two('value')} || ', no baseline yet' WHEN n < 8 THEN {two('value')} || ', baseline of ' || n || ' samples' ELSE {two('value')} || ' against ' || {two('median')} || ' +/- ' || {two('mad')} END, CASE WHEN verdict IN ('critical', 'warning') THEN CASE WHEN abs(z) >= CASE verdict WHEN 'critical' THEN 7.0 ELSE 3.5 END THEN 'z-score' ELSE format('{{:.1f}}x worse than baseline', ratio) END WHEN verdict = 'improved' THEN 'improved' END, CASE WHEN noisy AND verdict <> 'improved' THEN 'noisy baseline' END) AS reason FROM found")
def detect_regressions(spark, sf):
    k = table(spark, sf, "kpi")
    return rounded(op.detect_regressions(k, op.baselines(k)).select("id", "run_id", "scope_key", "value", "z", "relative", "ratio", "noisy", "verdict", "reason"), "z", "relative", "ratio")


@query("regression_report", f"{REGRESSIONS} SELECT id, scope_key, verdict, count(*) FILTER (verdict IN ('critical', 'warning')) OVER (PARTITION BY scope_key) AS regressions FROM found WHERE verdict <> 'ok'")
def regression_report(spark, sf):
    k = table(spark, sf, "kpi")
    return op.regression_report(op.detect_regressions(k, op.baselines(k))).select("id", "scope_key", "verdict", "regressions")


@query("kpi_rollup", f"{KPI} SELECT endpoint_name, probe, count(*) AS n, round(avg(value), 8) AS avg_value, round(min(value), 8) AS min_value, round(max(value), 8) AS max_value, min(unit) AS unit FROM kpi WHERE ok AND value IS NOT NULL GROUP BY ALL")
def kpi_rollup(spark, sf):
    return op.kpi_rollup(table(spark, sf, "kpi"), digits=8)


@query("query_kpis", f"{KPI} SELECT network, band, endpoint_name, probe, round(avg(value), 6) AS avg_value, count(*) AS n FROM kpi WHERE ok AND value IS NOT NULL AND network = 'net1' GROUP BY network, band, endpoint_name, probe ORDER BY network, band, endpoint_name, probe LIMIT 50")
def query_kpis(spark, sf):
    return rounded(op.query_kpis(table(spark, sf, "kpi"), network="net1"), "avg_value")


@query("jitter_rfc3550", f"{KPI}, s AS (SELECT *, abs(value - lag(value) OVER w) AS d, row_number() OVER w AS i, count(*) OVER (PARTITION BY run_id, endpoint_name) AS n FROM kpi WHERE ok AND value IS NOT NULL AND probe = 'icmp_rtt' WINDOW w AS (PARTITION BY run_id, endpoint_name ORDER BY id)) SELECT run_id, endpoint_name, round(coalesce(sum(d / 16 * pow(15.0 / 16, n - i)), 0.0), 6) AS jitter FROM s GROUP BY ALL")
def jitter_rfc3550(spark, sf):
    k = op.kpi_scope_filter(table(spark, sf, "kpi"), probe="icmp_rtt")
    return rounded(op.jitter_rfc3550(k, "id", "run_id", "endpoint_name"), "jitter")


FEATURES = [f"ep{i}.{p}" for i in range(5) for p in ("dns", "icmp_rtt", "jitter", "loss", "throughput")]
CELLS = f"{KPI}, cells AS (SELECT run_id, endpoint_name || '.' || probe AS feature, arg_max(value, id) AS value FROM kpi WHERE ok AND value IS NOT NULL GROUP BY ALL)"


@query("kpi_pivot", CELLS + " SELECT run_id, " + ", ".join(f"max(value) FILTER (feature = '{x}') AS \"{x}\"" for x in FEATURES) + " FROM cells GROUP BY run_id")
def kpi_pivot(spark, sf):
    return op.kpi_pivot(table(spark, sf, "kpi"), FEATURES)


@query("common_features", f"{CELLS} SELECT feature, count(DISTINCT run_id) AS n FROM cells GROUP BY feature HAVING count(DISTINCT run_id) = (SELECT count(DISTINCT run_id) FROM cells)")
def common_features(spark, sf):
    return op.common_features(op.kpi_features(table(spark, sf, "kpi")))


@query("robust_scale", f"{CELLS}, q AS (SELECT feature, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM cells GROUP BY feature) SELECT run_id, feature, round((value - m) / CASE WHEN iqr = 0 THEN 1.0 ELSE iqr END, 6) AS scaled FROM cells JOIN q USING (feature)")
def robust_scale(spark, sf):
    return rounded(op.robust_scale(op.kpi_features(table(spark, sf, "kpi"))), "scaled")


DEVIATIONS = f"{CELLS}, m AS (SELECT *, median(value) OVER (PARTITION BY feature) AS m FROM cells), s AS (SELECT *, median(abs(value - m)) OVER (PARTITION BY feature) AS mad FROM m), dev AS (SELECT run_id, feature, (value - m) / CASE WHEN mad = 0 THEN 1e-9 ELSE mad END AS deviation FROM s)"


@query("mad_deviations", f"{DEVIATIONS} SELECT run_id, feature, round(deviation, 4) AS deviation FROM dev")
def mad_deviations(spark, sf):
    return op.mad_deviations(op.kpi_features(table(spark, sf, "kpi"))).withColumn("deviation", F.round("deviation", 4))


@query("top_deviations", f"{DEVIATIONS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY abs(deviation) DESC, feature) AS rank FROM (SELECT run_id, feature, round(deviation, 4) AS deviation FROM dev)) SELECT run_id, feature, deviation, rank FROM ranked WHERE rank <= 3")
def top_deviations(spark, sf):
    d = op.mad_deviations(op.kpi_features(table(spark, sf, "kpi"))).withColumn("deviation", F.round("deviation", 4))
    return op.top_deviations(d).withColumn("rank", F.col("rank").cast("long"))


LINK = """WITH l AS (SELECT event_id, CAST(-40 - event_id % 70 AS INT) AS rssi_dbm, CAST(-95 + event_id % 10 AS INT) AS noise_dbm, CAST(CASE event_id % 5 WHEN 0 THEN 20 WHEN 1 THEN 40 WHEN 2 THEN 80 WHEN 3 THEN 160 ELSE 77 END AS INT) AS width_mhz, CAST(event_id % 3000 AS DOUBLE) AS tx_rate_mbps, CASE WHEN event_id % 2 = 0 THEN '5GHz' ELSE '2.4GHz' END AS band, CAST(event_id % 180 AS INT) AS channel FROM events),
link AS (SELECT *, CAST(rssi_dbm - noise_dbm + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS INT) AS snr_db FROM l)"""
QUALITY = "CASE WHEN snr_db >= 40 THEN 'excellent' WHEN snr_db >= 25 THEN 'good' WHEN snr_db >= 15 THEN 'fair' ELSE 'poor' END"


def link(spark, sf):
    return spark.sql(LINK.replace("FROM events", "FROM {e}") + " SELECT * FROM link", e=table(spark, sf, "events"))


@query("link_quality", f"{LINK} SELECT event_id, snr_db, {QUALITY} AS quality, rssi_dbm > -80 AS usable FROM link")
def link_quality(spark, sf):
    return link(spark, sf).select("event_id", "snr_db", f.link_quality(F.col("snr_db")).alias("quality"), (F.col("rssi_dbm") > -80).alias("usable"))


@query("link_plausibility_check", f"""{LINK}, q AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'good' ELSE {QUALITY} END AS quality FROM link), v AS (
SELECT event_id, 'rssi_range' AS rule FROM q WHERE NOT rssi_dbm BETWEEN -100 AND -10 UNION ALL SELECT event_id, 'noise_range' FROM q WHERE NOT noise_dbm BETWEEN -120 AND -60 UNION ALL SELECT event_id, 'snr_sum' FROM q WHERE snr_db <> rssi_dbm - noise_dbm UNION ALL SELECT event_id, 'snr_low' FROM q WHERE snr_db < 10
UNION ALL SELECT event_id, 'channel_band' FROM q WHERE CASE band WHEN '2.4GHz' THEN NOT channel BETWEEN 1 AND 14 ELSE NOT channel BETWEEN 32 AND 177 END UNION ALL SELECT event_id, 'width' FROM q WHERE width_mhz NOT IN (20, 40, 80, 160, 320)
UNION ALL SELECT event_id, 'rate' FROM q WHERE NOT (tx_rate_mbps > 0 AND tx_rate_mbps <= CASE width_mhz WHEN 20 THEN 600 WHEN 40 THEN 1200 WHEN 80 THEN 2500 WHEN 160 THEN 5000 ELSE 12000 END) UNION ALL SELECT event_id, 'quality' FROM q WHERE quality <> {QUALITY}) SELECT * FROM v""")
def link_plausibility_check(spark, sf):
    l = link(spark, sf).withColumn("quality", F.when(F.col("event_id") % 9 == 0, "good").otherwise(f.link_quality(F.col("snr_db"))))
    return op.link_plausibility_check(l).select("event_id", "rule")


@query("parse_scope", f"{KPI} SELECT id, split_part({KEY}, '|', 1) AS network, split_part({KEY}, '|', 2) AS band, split_part({KEY}, '|', 3) AS endpoint_name, split_part({KEY}, '|', 4) AS probe FROM kpi")
def parse_scope(spark, sf):
    k = table(spark, sf, "kpi").select("id", f.scope_key().alias("key"))
    return k.select("id", *(f.scope_part(F.col("key"), i).alias(n) for i, n in enumerate(f.SCOPE)))
