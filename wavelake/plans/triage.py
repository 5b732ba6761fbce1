"""Queries over merged evidence, diagnoses and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import failures as fa
from ..operators import frames as fr
from ..operators import kpi as kp
from ..operators import logs as lg
from ..operators import timeline as tl
from ..operators import triage as op
from ..session import written
from .fixtures import ctes, table
from .frames import facts
from .logs import PARSED, lines
from .registry import query

DATA = "ftype = 2 AND key_info IS NULL"
SEVERITY = "CASE level WHEN 'ERROR' THEN 'error' WHEN 'WARN' THEN 'warning' ELSE 'info' END"
SAMPLES = "SELECT 'tag' || user_id AS tag, event_id AS monotonic_ms, event_id AS id, 'p' || (event_id % 3) AS probe, value, 'ms' AS unit FROM events"
EVENTS = f"""{PARSED}, ev AS (SELECT tag, monotonic_ms, 2 AS source_rank, CAST(line_no AS BIGINT) AS seq, 'log' AS source, component || ':' AS label, message AS detail, {SEVERITY} AS severity FROM q
UNION ALL SELECT tag, monotonic_ms, 1, id, 'kpi', probe, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) || unit, 'info' FROM ({SAMPLES}))"""


def samples(spark, sf):
    return spark.sql(SAMPLES.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))


def events(spark, sf):
    return tl.timeline(lines(spark, sf), None, samples(spark, sf))


@query("timeline", f"{EVENTS} SELECT tag, monotonic_ms, source_rank, seq, source, label, detail, severity FROM ev")
def timeline(spark, sf):
    return events(spark, sf)


@query("timeline_summary", f"{EVENTS}, n AS (SELECT tag, source, count(*) AS n, min(monotonic_ms) AS a, max(monotonic_ms) AS b FROM ev GROUP BY tag, source) SELECT tag, CAST(sum(n) AS BIGINT) AS n_events, string_agg(source || '=' || n, ' ' ORDER BY source) AS n_by_source, max(b) - min(a) AS duration_ms FROM n GROUP BY tag")
def timeline_summary(spark, sf):
    told = F.array_join(F.transform(F.array_sort(F.map_entries("n_by_source")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ")
    return tl.timeline_summary(events(spark, sf)).withColumn("n_by_source", told)


@query("around", f"{EVENTS}, pts AS (SELECT 'tag' || user_id AS tag, event_id AS at_ms FROM events WHERE event_type = 'error') SELECT ev.tag, ev.source, ev.seq, ev.monotonic_ms, pts.at_ms FROM ev JOIN pts ON pts.tag = ev.tag AND abs(ev.monotonic_ms - pts.at_ms) <= 500")
def around(spark, sf):
    """The events about each error of a log."""
    points = table(spark, sf, "events").where("event_type = 'error'").select(F.concat(F.lit("tag"), "user_id").alias("tag"), F.col("event_id").alias("at_ms"))
    return tl.around(events(spark, sf), points, 500).select("tag", "source", "seq", "monotonic_ms", "at_ms")


@query("error_context", f"{EVENTS}, fe AS (SELECT *, min(monotonic_ms) FILTER (severity = 'error') OVER (PARTITION BY tag) AS first_error_ms FROM ev) SELECT tag, monotonic_ms, source, seq, first_error_ms FROM fe WHERE abs(monotonic_ms - first_error_ms) <= 800")
def error_context(spark, sf):
    return tl.error_context(events(spark, sf), 800).select("tag", "monotonic_ms", "source", "seq", "first_error_ms")


@query("head_tail_events", f"{EVENTS}, e2 AS (SELECT * FROM ev WHERE tag NOT LIKE '%7'  OR severity <> 'error'), fe AS (SELECT *, min(monotonic_ms) FILTER (severity = 'error') OVER (PARTITION BY tag) AS f FROM e2), h AS (SELECT *, f IS NOT NULL AND abs(monotonic_ms - f) <= 1200 AS near FROM fe), r AS (SELECT *, row_number() OVER (PARTITION BY tag, near ORDER BY monotonic_ms, source_rank, seq) AS a, row_number() OVER (PARTITION BY tag ORDER BY monotonic_ms DESC, source_rank DESC, seq DESC) AS b FROM h) SELECT tag, monotonic_ms, source, seq FROM r WHERE (near AND a <= 30) OR (f IS NULL AND b <= 30)")
def head_tail_events(spark, sf):
    """Tags that end in 7 lose their errors first, so that there are logs with and without an error window."""
    e = events(spark, sf).where("tag not like '%7' or severity <> 'error'")
    return tl.head_tail_events(e).select("tag", "monotonic_ms", "source", "seq")


@query("frame_timeline")
def frame_timeline(spark, sf):
    return tl.timeline(None, table(spark, sf, "frames"))


TEXTS = "SELECT event_id, 'log: ' || CASE event_id % 12 WHEN 0 THEN 'x REASON=23 y' WHEN 1 THEN 'retransmitting M2' WHEN 2 THEN 'DHCPNAK' WHEN 3 THEN 'auth timeout' WHEN 4 THEN 'status=17' WHEN 5 THEN 'networks=0' WHEN 6 THEN 'reason=34' WHEN 7 THEN 'weak_signal' WHEN 8 THEN 'deauth received reason=1' WHEN 9 THEN 'cca_busy=80' WHEN 10 THEN 'beacon miss, reason=15' ELSE 'nothing' END AS text FROM events"


@query("rule_diagnosis", f"WITH t AS ({TEXTS}) SELECT event_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {k!r})' for k in keys)} THEN '{cause}|{owner}|{conf}'" for keys, cause, owner, conf in op.RULES) + " ELSE 'insufficient evidence|unknown|0.2' END AS diagnosis FROM t")
def rule_diagnosis(spark, sf):
    t = spark.sql(TEXTS.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))
    return op.rule_diagnosis(t).select("event_id", F.concat_ws("|", "root_cause", "suggested_owner", F.col("confidence").cast("string")).alias("diagnosis"))


BODY = """concat('{"root_cause": "c', CAST(event_id % 9 AS STRING), '", "confidence": ', CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '"high"' WHEN 1 THEN '1.7' WHEN 2 THEN '-3' ELSE concat('0.', CAST(event_id % 100 AS STRING)) END, ', "suggested_owner": "', CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'dhcp' WHEN 1 THEN 'The DHCP server' WHEN 2 THEN 'supplicant' WHEN 3 THEN 'driver' WHEN 4 THEN 'nobody' WHEN 5 THEN ' ISP ' ELSE 'environment' END, '"', CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "evidence": ["a", "b"]' END, '}')"""
NO_CAUSE = '{"root_cause": null, "confidence": 0.5}'
RESPONSE = f"CASE CAST(event_id % 4 AS INT) WHEN 0 THEN {BODY} WHEN 1 THEN concat('Here:', chr(10), '```json', chr(10), {BODY}, chr(10), '```') WHEN 2 THEN concat('I think ', {BODY}, ' is it') ELSE CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'no idea' WHEN 1 THEN concat({BODY}, ' or ', {BODY}) ELSE '{NO_CAUSE}' END END AS response"
RESPONSES = f"SELECT event_id, {RESPONSE} FROM events"
PARSE = f"WITH r AS ({RESPONSES}), p AS (SELECT event_id, CASE WHEN event_id % 4 < 3 OR event_id % 3 = 2 THEN regexp_extract(response, '(?s)(\\{{.*\\}})', 1) END AS j FROM r), v AS (SELECT event_id, j IS NOT NULL AS parsed, j ->> 'root_cause' AS root_cause, j ->> 'confidence' AS confidence, j ->> 'suggested_owner' AS owner, json_array_length(j, '$.evidence') AS n FROM p)"


def responses(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", RESPONSE)


@query("parse_verdicts", f"{PARSE} SELECT event_id, parsed, root_cause, confidence, owner AS suggested_owner FROM v")
def parse_verdicts(spark, sf):
    return op.parse_verdicts(responses(spark, sf)).select("event_id", "parsed", "root_cause", "confidence", "suggested_owner")


@query("coerce_verdicts", f"{PARSE}, o AS (SELECT *, greatest(0.0, least(1.0, coalesce(TRY_CAST(confidence AS DOUBLE), 0.0))) AS c, lower(trim(coalesce(owner, 'unknown'))) AS s, coalesce(n, 0) AS m FROM v) SELECT event_id, CASE WHEN m = 0 AND c > 0.5 THEN 0.5 ELSE c END AS confidence, CAST(m AS BIGINT) AS n_evidence, coalesce(list_filter([{', '.join(map(repr, op.OWNERS))}], lambda x: x = s)[1], list_filter([{', '.join(map(repr, op.OWNERS))}], lambda x: contains(s, x) OR contains(x, s))[1], 'unknown') AS suggested_owner FROM o")
def coerce_verdicts(spark, sf):
    return op.coerce_verdicts(op.parse_verdicts(responses(spark, sf))).select("event_id", "confidence", F.size("evidence").cast("long").alias("n_evidence"), "suggested_owner")


CASES = f"SELECT 'tag' || lpad(CAST(event_id AS STRING), 7, '0') AS tag, CASE CAST(event_id % 11 AS INT) {' '.join(f'WHEN {i} THEN {x!r}' for i, x in enumerate(op.EXPECTED))} ELSE 'NONE' END AS fault, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'dhcp' WHEN 1 THEN 'environment' WHEN 2 THEN 'wifi_infrastructure' ELSE 'supplicant' END AS suggested_owner FROM events"


@query("triage_accuracy", f"WITH c AS ({CASES}), o AS (SELECT *, row_number() OVER (PARTITION BY fault ORDER BY tag) AS r FROM c WHERE fault <> 'NONE') SELECT tag, fault, suggested_owner, CASE fault {' '.join(f'WHEN {k!r} THEN suggested_owner IN ({chr(44).join(map(repr, v))})' for k, v in op.EXPECTED.items())} ELSE false END AS correct FROM o WHERE r = 1")
def triage_accuracy(spark, sf):
    return op.triage_accuracy(spark.sql(CASES.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events")))


NAMES = ("header", "forensics", *op.DROPPED)
SECTIONS = f"SELECT CAST(event_id AS STRING) AS tag, name, repeat('x', CAST((event_id * 37 + place * 911) % 400 AS INT)) AS text FROM events CROSS JOIN (VALUES {', '.join(f'({x!r}, {i})' for i, x in enumerate(NAMES))}) AS n(name, place)"


@query("trim_to_budget", f"WITH s AS ({SECTIONS}), p AS (SELECT *, length(text) AS size, CASE name {' '.join(f'WHEN {x!r} THEN {i}' for i, x in enumerate(op.DROPPED, 1))} ELSE 99 END AS place FROM s), t AS (SELECT *, sum(size) OVER (PARTITION BY tag) AS total, coalesce(sum(size) OVER (PARTITION BY tag ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM p), d AS (SELECT *, place < 99 AND total - gone > 1200 AS dropped FROM t) SELECT tag, name, size, bool_or(dropped) OVER (PARTITION BY tag) AS truncated FROM d QUALIFY NOT dropped")
def trim_to_budget(spark, sf):
    s = spark.sql(SECTIONS.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))
    return op.trim_to_budget(s, 300).select("tag", "name", F.col("size").cast("long").alias("size"), "truncated")


@query("failure_bundle")
def failure_bundle(spark, sf):
    frames = table(spark, sf, "frames")
    own = written(lines(spark, sf).withColumn("tag", F.concat(F.lit("cap"), F.substr("tag", F.lit(4)))), "lines")
    every = written(fr.capture_facts(frames), "facts")
    window = tl.head_tail_events(tl.timeline(own, frames))
    forensics, mined = fr.connection_forensics(every), written(lg.drain_templates(own), "templates")
    hits = lg.match_template(own, mined).where("template_id is not null").groupBy("tag", "template_id").agg(F.count("*").alias("hits"))
    templates = hits.join(mined.select("template_id", F.array_join("tokens", " ").alias("text")), "template_id")
    clusters = fa.cluster_failures(fa.failure_signature(own, lg.state_path(own), forensics))
    kpi = table(spark, sf, "kpi")
    judged = kp.detect_regressions(kpi, kp.baselines(kpi)).join(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("cap"), "user_id").alias("tag")), "id")
    return op.failure_bundle(forensics, window, fr.rank_anomalies(fr.found(every)), lg.log_summary(own), templates, clusters, judged)


RADIO = "SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '149 (5GHz, 80MHz)' WHEN 1 THEN '6 (2.4GHz, 20MHz)' WHEN 2 THEN '37 (6GHz, 160MHz)' WHEN 3 THEN '' ELSE ' 44' END AS channel_text, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN concat('-', CAST(event_id % 90 AS STRING), ' dBm / -89 dBm') WHEN 1 THEN '-64 dBm' ELSE 'garbage' END AS signal_text, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '802.11be' WHEN 1 THEN 'Wi-Fi 6' WHEN 2 THEN '802.11ac' ELSE '802.11n' END AS phy_text, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'spairport_security_mode_wpa3_personal' WHEN 1 THEN 'WPA2 Enterprise' WHEN 2 THEN 'wpa2_personal' WHEN 3 THEN 'none' WHEN 4 THEN '802.1X' ELSE 'SAE' END AS security_text FROM events"


@query("parse_radio_fields", f"WITH r AS ({RADIO}), d AS (SELECT *, regexp_extract_all(signal_text, '(-?\\d+)\\s*dBm', 1) AS m, lower(phy_text) AS p, lower(security_text) AS s FROM r) SELECT event_id, coalesce(TRY_CAST(regexp_extract(channel_text, '^\\s*(\\d+)', 1) AS INT), 0) AS channel, CASE WHEN contains(channel_text, '6GHz') THEN '6GHz' WHEN contains(channel_text, '2.4GHz') THEN '2.4GHz' WHEN contains(channel_text, '5GHz') THEN '5GHz' END AS band, coalesce(TRY_CAST(regexp_extract(channel_text, '(\\d+)MHz', 1) AS INT), 0) AS width_mhz, coalesce(CAST(m[1] AS INT), 0) AS rssi_dbm, coalesce(CAST(m[2] AS INT), -95) AS noise_dbm, CASE WHEN contains(p, 'be') OR contains(p, 'wi-fi 7') THEN '11be' WHEN contains(p, 'ax') OR contains(p, 'wi-fi 6') THEN '11ax' WHEN contains(p, 'ac') THEN '11ac' ELSE '11n' END AS phy, CASE WHEN contains(s, 'sae') OR contains(s, 'wpa3') THEN 'wpa3_sae' WHEN contains(s, 'enterprise') OR contains(s, '8021x') OR contains(s, '802.1x') THEN 'wpa2_enterprise' WHEN contains(s, 'wpa2') OR contains(s, 'wpa_personal') OR contains(s, 'psk') THEN 'wpa2_psk' ELSE 'open' END AS security FROM d")
def parse_radio_fields(spark, sf):
    r = spark.sql(RADIO.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))
    return op.parse_radio_fields(r).select("event_id", "channel", "band", "width_mhz", "rssi_dbm", "noise_dbm", "phy", "security")


def pings(spark, sf):
    line = F.concat(F.lit("64 bytes: time="), F.col("value").cast("string"), F.lit(" ms"))
    e = table(spark, sf, "events").where("value is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"])
    return e.groupBy("user_id").agg(F.array_join(ordered, "\n").alias("text"))


@query("parse_ping_output", "WITH s AS (SELECT user_id, value, abs(value - lag(value) OVER w) AS d, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) AS n, round(100.0 * (100 - count(*)) / 100, 6) AS loss_pct, round(median(value), 6) AS rtt_ms, round(coalesce(sum(d / 16 * pow(15.0 / 16, n - i)), 0.0), 6) AS jitter_ms, true AS ok FROM s GROUP BY user_id")
def parse_ping_output(spark, sf):
    out = op.parse_ping_output(pings(spark, sf), 100).select("user_id", "n", "loss_pct", "rtt_ms", "jitter_ms", "ok")
    return out.withColumns({c: F.round(c, 6) for c in ("loss_pct", "rtt_ms", "jitter_ms")})
