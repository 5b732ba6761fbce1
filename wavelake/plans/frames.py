"""Queries over captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames as f
from ..operators import frames as op
from .fixtures import FRAMES, ctes, table
from .registry import query


def names_sql(value: str, names: dict, otherwise: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in names.items()) + f" ELSE {otherwise} END"


EAPOL = "CASE WHEN key_info & 256 = 0 AND key_info & 128 <> 0 THEN 'eapol_m1' WHEN key_info & 256 <> 0 AND key_info & 128 <> 0 AND (key_info & 64 <> 0 OR key_info & 512 <> 0) THEN 'eapol_m3' WHEN key_info & 256 <> 0 AND key_info & 512 <> 0 AND key_info & 128 = 0 THEN 'eapol_m4' WHEN key_info & 256 <> 0 AND key_info & 512 = 0 THEN 'eapol_m2' ELSE 'eapol_unknown' END"
KIND = f"CASE WHEN key_info IS NOT NULL THEN {EAPOL} WHEN ftype = 0 THEN CASE WHEN auth_algo = 3 THEN CASE WHEN auth_seq = 1 THEN 'sae_commit' ELSE 'sae_confirm' END ELSE {names_sql('subtype', f.MANAGEMENT, chr(39) + 'other' + chr(39))} END WHEN ftype = 1 THEN 'control' WHEN ftype = 2 THEN CASE WHEN subtype & 8 <> 0 THEN 'qos_data' ELSE 'data' END ELSE 'other' END"
KINDS = f"{ctes('frames')}, k AS (SELECT *, {KIND} AS kind FROM frames)"
GONE, AUTH, ASSOC = "kind IN ('deauth', 'disassoc')", "kind IN ('auth', 'sae_commit', 'sae_confirm')", "kind IN ('assoc_response', 'reassoc_response')"
n = lambda cond, name: f"count(*) FILTER ({cond}) AS {name}"
first = lambda x, cond, name: f"arg_min({x}, frame_index) FILTER ({cond}) AS {name}"
last = lambda x, cond, name: f"arg_max({x}, frame_index) FILTER ({cond}) AS {name}"
FACTS = f"""{KINDS}, z AS (SELECT *, sum(CASE WHEN rssi_dbm IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY frame_index) AS at_, count(rssi_dbm) OVER (PARTITION BY capture_id) AS n_, min(time_s) FILTER (kind = 'eapol_m4') OVER (PARTITION BY capture_id) AS m4_ FROM k),
raw_facts AS (SELECT capture_id, count(*) AS n_frames, arg_max(time_s, frame_index) - arg_min(time_s, frame_index) AS duration_s, {n('ftype = 2', 'n_data_frames')}, {n('ftype = 2 AND retry', 'data_retries')}, {n('retry', 'n_retries')}, {n('ftype = 0', 'n_mgmt_frames')}, {n('key_info IS NOT NULL', 'n_eapol')},
{', '.join(n(f"kind = 'eapol_m{i}'", f'm{i}') for i in (1, 2, 3, 4))}, {n(GONE, 'n_deauth')}, {n(GONE + ' AND NOT protected', 'n_unprotected')}, {last('time_s', GONE, 'g1')}, {first('time_s', GONE, 'g0')}, {last('reason_code', GONE, 'last_reason')}, {n('bad_fcs', 'n_bad')}, {n("kind IN ('beacon', 'probe_response')", 'n_scan')},
{n(AUTH, 'n_auth')}, {n(AUTH + ' AND status_code = 0', 'n_auth_ok')}, {n(AUTH + ' AND status_code <> 0', 'n_auth_bad')}, {last('status_code', AUTH + ' AND status_code <> 0', 'bad_auth_status')}, {n(ASSOC, 'n_assoc')}, {n(ASSOC + ' AND status_code = 0', 'n_assoc_ok')}, {last('status_code', ASSOC, 'assoc_status')}, {n("kind = 'assoc_request'", 'n_assoc_request')}, {n('ftype = 2 AND key_info IS NULL', 'n_plain_data')},
{first('rssi_dbm', 'rssi_dbm IS NOT NULL', 'rssi_first')}, {last('rssi_dbm', 'rssi_dbm IS NOT NULL', 'rssi_last')}, min(rssi_dbm) AS rssi_min, avg(rssi_dbm) AS rssi_mean, count(rssi_dbm) AS n_rssi, avg(rssi_dbm) FILTER (at_ <= floor(n_ / 3)) AS rssi_head, avg(rssi_dbm) FILTER (at_ > n_ - ceil(n_ / 3)) AS rssi_tail,
{first('ssid', "ssid IS NOT NULL AND ssid NOT IN ('', '<hidden>')", 'ssid')}, {first('rsn_akm', "rsn_akm IS NOT NULL AND rsn_akm <> ''", 'akm')}, {n("kind = 'eapol_m3' AND time_s >= m4_", 'm3_after_m4')},
{', '.join(f"{g}(time_s) FILTER (kind IN {k}) AS {a}" for a, g, k in (('t_probe', 'min', "('probe_request')"), ('t_beacon', 'min', "('beacon', 'probe_response')"), ('t_auth', 'min', "('auth', 'sae_commit')"), ('t_auth_end', 'max', "('auth', 'sae_confirm')"), ('t_assoc', 'min', "('assoc_request', 'reassoc_request')"), ('t_assoc_end', 'min', "('assoc_response', 'reassoc_response')"), ('t_m1', 'min', "('eapol_m1')"), ('t_m4', 'max', "('eapol_m4')"), ('t_eapol', 'max', "('eapol_m1', 'eapol_m2', 'eapol_m3', 'eapol_m4')")))} FROM z GROUP BY capture_id),
facts AS (SELECT *, g1 - g0 AS deauth_window_s, rssi_head - rssi_tail AS rssi_thirds_drop, CASE WHEN n_data_frames > 0 THEN data_retries / n_data_frames ELSE 0.0 END AS retry_rate FROM raw_facts)"""
TIMINGS = f"""{FACTS}, tm AS (SELECT capture_id, 'scan' AS stage, 1 AS o, t_probe AS a, t_beacon AS b FROM facts UNION ALL SELECT capture_id, 'authentication', 2, t_auth, t_auth_end FROM facts UNION ALL SELECT capture_id, 'association', 3, t_assoc, t_assoc_end FROM facts UNION ALL SELECT capture_id, '4-way handshake', 4, t_m1, coalesce(t_m4, t_eapol) FROM facts UNION ALL SELECT capture_id, 'scan->auth latency', 5, t_probe, t_auth FROM facts),
timings AS (SELECT capture_id, stage, o, round(a, 3) AS start_s, round(b, 3) AS end_s, CAST(trunc((b - a) * 1000) AS INT) AS duration_ms FROM tm WHERE b >= a)"""
ROAMS = f"""{FACTS}, asked AS (SELECT capture_id, frame_index, addr1, lag(addr1) OVER (PARTITION BY capture_id ORDER BY frame_index) AS was FROM k WHERE kind IN ('assoc_request', 'reassoc_request') AND addr1 <> ''),
steps AS (SELECT * FROM asked WHERE was IS NULL OR was <> addr1), roams AS (SELECT capture_id, string_agg(addr1, ' > ' ORDER BY frame_index) AS sequence, CAST(count(*) - 1 AS INT) AS transitions, count(DISTINCT addr1) < count(*) AS pingpong FROM steps GROUP BY capture_id)"""
UP = """ups AS (SELECT capture_id, count(DISTINCT replay_counter) > 1 AND NOT bool_or(falls) AS up FROM (SELECT capture_id, replay_counter, coalesce(lag(replay_counter) OVER (PARTITION BY capture_id ORDER BY frame_index) > replay_counter, false) AS falls FROM k WHERE kind = 'eapol_m3' AND replay_counter IS NOT NULL) GROUP BY capture_id)"""
S = {
    "excessive_retries": "SELECT capture_id, 'excessive_retries' AS detector, CASE WHEN retry_rate >= 0.40 THEN 'critical' ELSE 'warning' END AS severity, retry_rate AS value, data_retries || '/' || n_data_frames AS detail FROM facts WHERE n_data_frames >= 10 AND retry_rate >= 0.20",
    "weak_signal": "SELECT capture_id, 'weak_signal' AS detector, CASE WHEN rssi_min <= -88 THEN 'critical' ELSE 'warning' END AS severity, CAST(rssi_min AS DOUBLE) AS value, printf('mean %.6f', rssi_mean) AS detail FROM facts WHERE rssi_min <= -80",
    "rssi_collapse": "SELECT capture_id, 'rssi_collapse' AS detector, CASE WHEN n_deauth > 0 THEN 'critical' ELSE 'warning' END AS severity, rssi_thirds_drop AS value, '' AS detail FROM facts WHERE n_rssi >= 8 AND rssi_thirds_drop >= 12",
    "deauth_flood": f"SELECT facts.capture_id, 'deauth_flood' AS detector, 'critical' AS severity, CAST(n_deauth AS DOUBLE) AS value, concat_ws(' ', printf('%.2f s', deauth_window_s), why) AS detail FROM facts LEFT JOIN (SELECT capture_id, string_agg(reason_code || ':' || c, ' ' ORDER BY reason_code) AS why FROM (SELECT capture_id, reason_code, count(*) AS c FROM k WHERE {GONE} AND reason_code IS NOT NULL GROUP BY ALL) GROUP BY capture_id) USING (capture_id) WHERE n_deauth >= 5",
    "eapol_retransmission": " UNION ALL ".join(f"SELECT capture_id, 'eapol_retransmission' AS detector, 'critical' AS severity, CAST(m{i} AS DOUBLE) AS value, 'M{i} {'station' if i % 2 else 'AP'}' AS detail FROM facts WHERE m{i} > 2" for i in (1, 2, 3, 4)),
    "key_reinstallation": "SELECT capture_id, 'key_reinstallation' AS detector, 'critical' AS severity, CAST(m3_after_m4 AS DOUBLE) AS value, CASE WHEN up THEN 'increasing' ELSE 'not increasing' END AS detail FROM facts LEFT JOIN ups USING (capture_id) WHERE m3 >= 2 AND m4 > 0 AND m3_after_m4 > 0",
    "incomplete_handshake": "SELECT capture_id, 'incomplete_handshake' AS detector, 'critical' AS severity, CAST(0 AS DOUBLE) AS value, concat_ws(', ', CASE WHEN m1 = 0 THEN 'M1' END, CASE WHEN m2 = 0 THEN 'M2' END, CASE WHEN m3 = 0 THEN 'M3' END, CASE WHEN m4 = 0 THEN 'M4' END) AS detail FROM facts WHERE (m1 > 0 OR m2 > 0) AND NOT (m3 > 0 AND m4 > 0)",
    "roam_churn": "SELECT capture_id, 'roam_churn' AS detector, CASE WHEN pingpong THEN 'critical' ELSE 'warning' END AS severity, CAST(transitions AS DOUBLE) AS value, sequence AS detail FROM roams WHERE transitions >= 3",
    "bad_fcs": "SELECT capture_id, 'bad_fcs' AS detector, CASE WHEN n_bad / n_frames < 0.20 THEN 'warning' ELSE 'critical' END AS severity, n_bad / n_frames AS value, '' AS detail FROM facts WHERE n_bad > 0 AND n_bad / n_frames >= 0.05",
    "unprotected_management_frames": "SELECT capture_id, 'unprotected_management_frames' AS detector, 'info' AS severity, CAST(n_unprotected AS DOUBLE) AS value, akm AS detail FROM facts WHERE akm IS NOT NULL AND akm NOT IN ('SAE', 'FT-SAE', 'OWE') AND n_unprotected > 0",
}
FOUND = f"{ROAMS}, {UP}, found AS ({' UNION ALL '.join(S.values())})"


def frames(spark, sf):
    return table(spark, sf, "frames")


def facts(spark, sf):
    return op.capture_facts(frames(spark, sf))


def value6(df):
    return df.withColumn("value", F.round("value", 6))


@query("classify_frame_kind", f"{KINDS} SELECT capture_id, frame_index, kind FROM k")
def classify_frame_kind(spark, sf):
    return op.with_kind(frames(spark, sf)).select("capture_id", "frame_index", "kind")


@query("classify_eapol", f"WITH e AS (SELECT event_id, CAST(event_id % 8192 AS INT) AS key_info FROM events) SELECT event_id, {EAPOL} AS kind FROM e")
def classify_eapol(spark, sf):
    return table(spark, sf, "events").select("event_id", f.classify_eapol((F.col("event_id") % 8192).cast("int")).alias("kind"))


@query("frame_flags", "WITH e AS (SELECT event_id, CAST(event_id % 256 AS INT) AS x, CAST(event_id * 7 % 65536 AS INT) AS y FROM events) SELECT event_id, x & 8 <> 0 AS retry, x & 64 <> 0 AS protected, y >> 4 AS seq, x / 2 AS rate_mbps, y & 16383 AS aid, x & 64 <> 0 AS bad_fcs FROM e")
def frame_flags(spark, sf):
    x, y = (F.col("event_id") % 256).cast("int"), (F.col("event_id") * 7 % 65536).cast("int")
    e = table(spark, sf, "events").select("event_id", x.alias("fc_flags"), y.alias("seq_ctrl"), x.alias("raw_rate"), y.alias("raw_aid"), x.alias("radio_flags"))
    return op.frame_flags(e).select("event_id", "retry", "protected", "seq", "rate_mbps", "aid", "bad_fcs")


@query("akm_suite_name", "SELECT event_id, " + names_sql("event_id % 20", f.AKM, "'akm-' || (event_id % 20)") + " AS akm FROM events")
def akm_suite_name(spark, sf):
    return table(spark, sf, "events").select("event_id", f.akm_name(F.col("event_id") % 20).alias("akm"))


@query("ieee_code_name", "SELECT event_id, " + names_sql("event_id % 60", f.REASONS, "'unknown'") + " AS reason, " + names_sql("event_id % 60", f.STATUSES, "'unknown'") + " AS status FROM events")
def ieee_code_name(spark, sf):
    return table(spark, sf, "events").select("event_id", f.reason_name(F.col("event_id") % 60).alias("reason"), f.status_name(F.col("event_id") % 60).alias("status"))


@query("frames_of_kind", f"{KINDS} SELECT capture_id, frame_index, kind, NULL AS present FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY frame_index) AS rank FROM k WHERE kind IN ('disassoc', 'auth')) WHERE rank <= 3 UNION ALL SELECT capture_id, NULL, NULL, string_agg(DISTINCT kind, ', ' ORDER BY kind) FROM k GROUP BY capture_id HAVING count(*) FILTER (kind IN ('disassoc', 'auth')) = 0")
def frames_of_kind(spark, sf):
    return op.frames_of_kind(op.with_kind(frames(spark, sf)), "disassoc", "auth", limit=3).select("capture_id", "frame_index", "kind", "present")


@query("capture_summary", f"{FACTS} SELECT capture_id, n_frames, round(duration_s, 3) AS duration_s, n_data_frames, round(retry_rate, 6) AS retry_rate, rssi_first, rssi_last, ssid, akm, n_deauth, n_eapol, by_kind FROM facts JOIN (SELECT capture_id, string_agg(kind || '=' || n, ' ' ORDER BY kind) AS by_kind FROM (SELECT capture_id, kind, count(*) AS n FROM k GROUP BY ALL) GROUP BY capture_id) USING (capture_id)")
def capture_summary(spark, sf):
    told = F.array_join(F.transform(F.array_sort(F.map_entries("by_kind")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ")
    return op.capture_summary(frames(spark, sf)).withColumns({"by_kind": told, "duration_s": F.round("duration_s", 3), "retry_rate": F.round("retry_rate", 6)})


@query("bssid_ranking", f"{KINDS} SELECT capture_id, addr3, count(*) AS n, row_number() OVER (PARTITION BY capture_id ORDER BY count(*) DESC, min(frame_index)) AS rank FROM k WHERE ftype = 0 AND addr3 <> '' GROUP BY capture_id, addr3")
def bssid_ranking(spark, sf):
    return op.bssid_ranking(frames(spark, sf)).select("capture_id", "addr3", "n", F.col("rank").cast("long"))


@query("stage_timings", f"{TIMINGS} SELECT capture_id, stage, start_s, end_s, duration_ms FROM timings")
def stage_timings(spark, sf):
    return op.stage_timings(facts(spark, sf)).withColumns({"start_s": F.round("start_s", 3), "end_s": F.round("end_s", 3)})


@query("slowest_stage", f"{TIMINGS} SELECT capture_id, stage, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY duration_ms DESC, o) AS r FROM timings) WHERE r = 1")
def slowest_stage(spark, sf):
    return op.slowest_stage(op.stage_timings(facts(spark, sf)))


@query("roam_sequence", f"{ROAMS} SELECT * FROM roams")
def roam_sequence(spark, sf):
    return op.roam_sequence(frames(spark, sf)).withColumn("sequence", F.array_join("sequence", " > "))


@query("rssi_thirds", f"{FACTS} SELECT capture_id, n_rssi, round(rssi_head, 6) AS rssi_head, round(rssi_tail, 6) AS rssi_tail, round(rssi_thirds_drop, 6) AS rssi_thirds_drop FROM facts")
def rssi_thirds(spark, sf):
    return facts(spark, sf).select("capture_id", "n_rssi", *(F.round(c, 6).alias(c) for c in ("rssi_head", "rssi_tail", "rssi_thirds_drop")))


def _detector(name, detector, run):
    sql = S[detector] if detector in ("roam_churn", "key_reinstallation") else S[detector]
    query(name, f"{ROAMS}, {UP}, found AS ({sql}) SELECT capture_id, detector, severity, round(value, 6) AS value, detail FROM found")(lambda spark, sf: value6(run(spark, sf)))


for _name, _d, _run in (
    ("detect_excessive_retries", "excessive_retries", lambda s, d: op.detect_excessive_retries(facts(s, d))),
    ("detect_weak_signal", "weak_signal", lambda s, d: op.detect_weak_signal(facts(s, d))),
    ("detect_rssi_collapse", "rssi_collapse", lambda s, d: op.detect_rssi_collapse(facts(s, d))),
    ("detect_deauth_flood", "deauth_flood", lambda s, d: op.detect_deauth_flood(facts(s, d))),
    ("detect_eapol_retransmissions", "eapol_retransmission", lambda s, d: op.detect_eapol_retransmissions(facts(s, d))),
    ("detect_key_reinstallation", "key_reinstallation", lambda s, d: op.detect_key_reinstallation(facts(s, d))),
    ("detect_incomplete_handshake", "incomplete_handshake", lambda s, d: op.detect_incomplete_handshake(facts(s, d))),
    ("detect_roam_churn", "roam_churn", lambda s, d: op.detect_roam_churn(facts(s, d))),
    ("detect_bad_fcs", "bad_fcs", lambda s, d: op.detect_bad_fcs(facts(s, d))),
    ("detect_unprotected_mgmt", "unprotected_management_frames", lambda s, d: op.detect_unprotected_mgmt(facts(s, d))),
):
    _detector(_name, _d, _run)


@query("scan_captures", f"{FOUND} SELECT capture_id, detector, severity, round(value, 6) AS value, detail FROM found")
def scan_captures(spark, sf):
    return value6(op.scan_captures(frames(spark, sf)))


def place(names, c):
    return "CASE " + c + " " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(names)) + " END"


@query("rank_anomalies", f"{FOUND} SELECT capture_id, detector, severity, row_number() OVER (PARTITION BY capture_id ORDER BY {place(op.SEVERITIES, 'severity')}, {place(op.DETECTORS, 'detector')}, detail) AS rank FROM found")
def rank_anomalies(spark, sf):
    return op.rank_anomalies(op.scan_captures(frames(spark, sf))).select("capture_id", "detector", "severity", F.col("rank").cast("long"))


FORENSICS = f"""{FACTS}, st AS (SELECT *, CASE WHEN n_plain_data > 0 THEN 5 WHEN m3 > 0 AND m4 > 0 THEN 4 WHEN n_assoc_ok > 0 THEN 3 WHEN n_auth_ok > 0 THEN 2 WHEN n_scan > 0 THEN 1 ELSE 0 END AS sr FROM facts),
ru AS (SELECT *, CASE WHEN n_scan = 0 THEN 2 WHEN n_auth = 0 THEN 3 WHEN n_auth_bad > 0 AND n_assoc = 0 THEN 4 WHEN n_assoc = 0 AND n_assoc_request = 0 THEN 5 WHEN n_assoc > 0 AND n_assoc_ok = 0 THEN 6 WHEN sr = 3 AND (m1 > 0 OR m2 > 0) THEN 7 WHEN sr >= 4 AND n_deauth > 0 AND last_reason IN (3, 8) THEN 8 WHEN sr >= 4 AND n_deauth > 0 THEN 9 WHEN sr = 5 THEN 10 WHEN sr = 4 THEN 11 WHEN sr = 3 THEN 12 ELSE 13 END AS rule FROM st),
ca AS (SELECT *, CASE rule WHEN 7 THEN CASE WHEN m1 > 0 AND m2 = 0 THEN 'no M2' WHEN m2 > 0 AND m3 = 0 THEN CASE last_reason WHEN 23 THEN 'no M3, credentials' WHEN 15 THEN 'no M3, timeout' ELSE 'no M3' END WHEN m3 > 0 AND m4 = 0 THEN 'no M4' ELSE '' END WHEN 9 THEN CASE WHEN last_reason = 34 THEN 'beacon loss' ELSE 'torn down' END WHEN 12 THEN CASE WHEN akm IS NULL THEN 'open' ELSE 'handshake missing' END ELSE '' END AS sub FROM ru),
fo AS (SELECT *, ['nothing', 'scanned', 'authenticated', 'associated', 'keyed', 'data'][sr + 1] AS stage_reached, rule IN (8, 10, 11) OR (rule = 12 AND sub = 'open') AS succeeded,
CASE WHEN rule IN (1, 2) THEN 'nothing' WHEN rule IN (3, 4, 5) THEN 'scanned' WHEN rule = 6 THEN 'authenticated' WHEN rule = 7 AND sub <> '' THEN 'associated' WHEN rule = 9 THEN ['nothing', 'scanned', 'authenticated', 'associated', 'keyed', 'data'][sr + 1] WHEN rule = 12 AND sub <> 'open' THEN 'associated' END AS failed_at,
CASE WHEN rule = 4 THEN bad_auth_status WHEN n_assoc > 0 AND n_assoc_ok = 0 THEN assoc_status END AS status_code, concat_ws(' ', {', '.join(f"CASE WHEN m{i} = 1 THEN 'M{i}' WHEN m{i} > 1 THEN 'M{i}x' || m{i} END" for i in (1, 2, 3, 4))}) AS eapol_seen,
concat_ws('; ', CASE WHEN rule = 2 THEN n_frames || ' frames, none from an AP' END, CASE WHEN rule = 5 THEN n_auth || ' auth frames, no association' END, CASE WHEN rule = 7 AND m2 > 0 AND m3 = 0 THEN 'M2 sent ' || m2 || ' times, no M3' END, CASE WHEN rule IN (8, 10) AND retry_rate > 0.20 THEN 'retry rate over 20%' END, CASE WHEN rule IN (8, 9) AND rssi_last < -80 THEN 'signal ended at ' || rssi_last || ' dBm' END) AS evidence FROM ca)"""


@query("connection_forensics", f'{FORENSICS} SELECT capture_id, stage_reached, rule, sub AS "case", succeeded, failed_at, status_code, last_reason AS reason_code, eapol_seen, evidence FROM fo')
def connection_forensics(spark, sf):
    return op.connection_forensics(facts(spark, sf)).select("capture_id", "stage_reached", "rule", "case", "succeeded", "failed_at", "status_code", "reason_code", "eapol_seen", F.array_join("evidence", "; ").alias("evidence"))


FIELDS = ("subtype", "status_code", "reason_code", "ssid", "retry", "rssi_dbm")
THEIRS = "SELECT capture_id, frame_index, subtype, CASE WHEN frame_index % 11 <> 0 THEN status_code END AS status_code, reason_code, ssid, CASE WHEN frame_index % 13 = 0 THEN NOT retry ELSE retry END AS retry, rssi_dbm FROM frames WHERE frame_index % 97 <> 0"


@query("reconcile_frames", f"{ctes('frames')}, theirs AS ({THEIRS}), j AS (SELECT capture_id, frame_index, {', '.join(f'CAST(a.{x} AS VARCHAR) AS a_{x}, CAST(b.{x} AS VARCHAR) AS b_{x}' for x in FIELDS)}, a.subtype IS NULL OR b.subtype IS NULL AS lone, a.subtype IS NOT NULL AS ours_has FROM frames a FULL JOIN theirs b USING (capture_id, frame_index)) SELECT capture_id, frame_index, 'frame' AS field, CASE WHEN ours_has THEN 'seen' END AS ours, CASE WHEN NOT ours_has THEN 'seen' END AS theirs FROM j WHERE lone UNION ALL " + " UNION ALL ".join(f"SELECT capture_id, frame_index, '{x}', a_{x}, b_{x} FROM j WHERE NOT lone AND a_{x} IS DISTINCT FROM b_{x}" for x in FIELDS))
def reconcile_frames(spark, sf):
    ours = frames(spark, sf)
    theirs = spark.sql(THEIRS.replace("FROM frames", "FROM {fr}"), fr=ours)
    return op.reconcile_frames(ours, theirs, FIELDS)


@query("collapse_data_frames")
def collapse_data_frames(spark, sf):
    return op.collapse_data_frames(frames(spark, sf)).select("capture_id", "frame_index", "monotonic_ms", "n", "retries", F.round("retry_share", 6).alias("retry_share"), "severity")


#: What another dissector printed of the frames: hex SSIDs, signals of two antennas, some fields wrong, missing or no numbers, some frames malformed or lost.
PRINTED = """SELECT capture_id, frame_index, CASE WHEN ftype <> 0 THEN '' WHEN frame_index % 17 = 0 THEN '0x0e' WHEN frame_index % 2 = 0 THEN concat('0x', lower(hex(subtype))) ELSE CAST(subtype AS STRING) END AS type_subtype, CASE WHEN frame_index % 13 = 0 THEN '' WHEN frame_index % 41 = 0 THEN CASE WHEN retry THEN '0' ELSE '1' END WHEN retry THEN '1' ELSE '0' END AS retry,
 CASE WHEN frame_index % 11 = 0 THEN 'n/a' ELSE CAST(status_code AS STRING) END AS status_code, CAST(CASE WHEN frame_index % 19 = 0 THEN reason_code + 1 ELSE reason_code END AS STRING) AS reason_code, CASE WHEN frame_index % 3 = 0 THEN ssid ELSE lower(hex(ssid)) END AS ssid, concat(CAST(CASE WHEN frame_index % 53 = 0 THEN -1 ELSE rssi_dbm END AS STRING), ',-99') AS rssi,
 CASE WHEN key_info IS NOT NULL AND frame_index % 29 <> 0 THEN '3' END AS eapol, CASE WHEN frame_index % 37 = 0 THEN 'yes' END AS malformed FROM frames WHERE frame_index % 97 <> 0 OR capture_id LIKE '%1'"""
NAMED = " ".join(f"WHEN '{k}' THEN {v}" for k, v in op.SUBTYPES.items())
DIFFER = f"""{KINDS}, pr AS ({PRINTED.replace('AS STRING', 'AS VARCHAR')}), jo AS (SELECT k.capture_id, k.frame_index, CAST(CASE kind {NAMED} END AS BIGINT) AS o1, CASE WHEN starts_with(p.type_subtype, '0x') THEN CAST('0x' || substr(p.type_subtype, 3) AS BIGINT) ELSE TRY_CAST(p.type_subtype AS BIGINT) END AS t1, CAST(k.status_code AS BIGINT) AS o2, TRY_CAST(p.status_code AS BIGINT) AS t2, CAST(k.reason_code AS BIGINT) AS o3, TRY_CAST(p.reason_code AS BIGINT) AS t3,
 nullif(k.ssid, '') AS o4, nullif(CASE WHEN regexp_full_match(p.ssid, '([0-9a-f][0-9a-f])+') THEN decode(unhex(p.ssid)) ELSE p.ssid END, '') AS t4, k.retry AS o5, CASE p.retry WHEN '1' THEN true WHEN '0' THEN false END AS t5, CAST(k.rssi_dbm AS BIGINT) AS o6, TRY_CAST(split_part(p.rssi, ',', 1) AS BIGINT) AS t6, k.key_info IS NOT NULL AS o7, coalesce(p.eapol, '') <> '' AS t7 FROM k JOIN pr p ON p.capture_id = k.capture_id AND p.frame_index = k.frame_index),
 di AS ({' UNION ALL '.join(f"SELECT capture_id, frame_index, '{x}' AS field, CAST(o{i} AS VARCHAR) AS ours, CAST(t{i} AS VARCHAR) AS theirs FROM jo WHERE o{i} <> t{i}" for i, x in enumerate(('type_subtype', 'status_code', 'reason_code', 'ssid', 'retry', 'rssi_dbm', 'is_eapol'), 1))})"""


def printed(spark, sf):
    return spark.sql(PRINTED.replace("FROM frames", "FROM {fr}"), fr=frames(spark, sf))


@query("reconcile_dissections", f"{DIFFER} SELECT * FROM di")
def reconcile_dissections(spark, sf):
    return op.reconcile_dissections(frames(spark, sf), printed(spark, sf))


@query("reconciled_captures", f"""{DIFFER}, co AS (SELECT capture_id, count(*) AS n FROM k GROUP BY 1), ct AS (SELECT capture_id, count(*) AS n, array_to_string(list(frame_index ORDER BY frame_index) FILTER (malformed <> ''), ' ') AS malformed FROM pr GROUP BY 1), dn AS (SELECT capture_id, count(*) AS n FROM di GROUP BY 1)
SELECT capture_id, co.n AS n_ours, coalesce(ct.n, 0) AS n_theirs, coalesce(dn.n, 0) AS n_differences, coalesce(ct.malformed, '') AS malformed, co.n = coalesce(ct.n, 0) AND coalesce(dn.n, 0) = 0 AS agrees FROM co LEFT JOIN ct USING (capture_id) LEFT JOIN dn USING (capture_id)""")
def reconciled_captures(spark, sf):
    return op.reconciled_captures(frames(spark, sf), printed(spark, sf)).withColumn("malformed", F.array_join("malformed", " "))
