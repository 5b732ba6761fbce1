"""Captures: what their frames say of the connection. Frames of one capture are ordered by frame_index."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import frames as f
from ..session import ship

#: Severities from the worst, detectors in order.
SEVERITIES = ("critical", "warning", "info")
DETECTORS = ("excessive_retries", "weak_signal", "rssi_collapse", "deauth_flood", "eapol_retransmission", "key_reinstallation", "incomplete_handshake", "roam_churn", "bad_fcs", "unprotected_management_frames")


def by_frame():
    return W.partitionBy("capture_id").orderBy("frame_index")


def with_kind(frames: DataFrame) -> DataFrame:
    c = F.col
    return frames.withColumn("kind", f.frame_kind(c("ftype"), c("subtype"), c("auth_algo"), c("auth_seq"), c("key_info")))


def frame_flags(raw: DataFrame) -> DataFrame:
    """Bits of frame control, sequence control, rate, association id and the radio's flags."""
    bit = lambda column, mask: F.col(column).bitwiseAND(mask) != 0
    return raw.withColumns({"retry": bit("fc_flags", 0x08), "protected": bit("fc_flags", 0x40), "seq": F.shiftright("seq_ctrl", 4), "rate_mbps": F.col("raw_rate") / 2.0, "aid": F.col("raw_aid").bitwiseAND(0x3FFF), "bad_fcs": bit("radio_flags", 0x40)})


def frames_of_kind(kinds: DataFrame, *wanted: str, limit: int = 50) -> DataFrame:
    """The first frames of the kinds of each capture; of a capture without any, a row without a frame that names the kinds that it has (present)."""
    present = F.array_join(F.array_sort(F.collect_set("kind")), ", ")
    none = kinds.groupBy("capture_id").agg(present.alias("present"), F.count_if(F.col("kind").isin(*wanted)).alias("_n")).where("_n = 0").drop("_n")
    found = kinds.where(F.col("kind").isin(*wanted)).withColumn("rank", F.row_number().over(by_frame())).where(F.col("rank") <= limit)
    return found.unionByName(none, allowMissingColumns=True)


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _first(value: Column, when: Column) -> Column:
    return F.min_by(value, F.when(when, F.col("frame_index")))


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("frame_index")))


def capture_facts(frames: DataFrame) -> DataFrame:
    """One wide row for each capture, which all detectors, timings and verdicts are made from: one shuffle for all of them."""
    c, kinds = F.col, with_kind(frames)
    auth, assoc = _is("auth", "sae_commit", "sae_confirm"), _is("assoc_response", "reassoc_response")
    gone, eapol, data = _is(*f.DISCONNECTS), c("key_info").isNotNull(), c("ftype") == 2
    rssi = c("rssi_dbm").isNotNull()
    n = W.partitionBy("capture_id")
    # the place of each signal value among those of its capture, for the first and last thirds
    kinds = kinds.withColumns({"_at": F.sum(rssi.cast("int")).over(by_frame()), "_n": F.sum(rssi.cast("int")).over(n), "_m4": F.min(F.when(_is("eapol_m4"), c("time_s"))).over(n)})
    # what was before a frame: the access point asked for last, the replay counter of the last M3; and how often its reason is given
    asked, m3 = _is("assoc_request", "reassoc_request") & (F.coalesce("addr1", F.lit("")) != ""), _is("eapol_m3") & c("replay_counter").isNotNull()
    earlier = by_frame().rowsBetween(W.unboundedPreceding, -1)
    kinds = kinds.withColumns({"_asked": F.last(F.when(asked, c("addr1")), ignorenulls=True).over(earlier), "_counter": F.last(F.when(m3, c("replay_counter")), ignorenulls=True).over(earlier), "_reasons": F.count_if(gone).over(W.partitionBy("capture_id", "reason_code"))})
    step = asked & (c("_asked").isNull() | (c("_asked") != c("addr1")))
    head, tail = rssi & (c("_at") <= F.floor(c("_n") / 3)), rssi & (c("_at") > c("_n") - F.ceil(c("_n") / 3))
    times = lambda k: F.count_if(_is(k))
    t = c("time_s")
    return kinds.groupBy("capture_id").agg(
        F.count("*").alias("n_frames"), (_last(t, F.lit(True)) - _first(t, F.lit(True))).alias("duration_s"), F.count_if(data).alias("n_data_frames"), F.count_if(data & c("retry")).alias("data_retries"), F.count_if("retry").alias("n_retries"),
        F.count_if(c("ftype") == 0).alias("n_mgmt_frames"), F.count_if(eapol).alias("n_eapol"), *(times(f"eapol_m{i}").alias(f"m{i}") for i in (1, 2, 3, 4)), F.count_if(gone).alias("n_deauth"), F.count_if(gone & ~c("protected")).alias("n_unprotected"),
        (_last(t, gone) - _first(t, gone)).alias("deauth_window_s"), _last(c("reason_code"), gone).alias("last_reason"), F.count_if("bad_fcs").alias("n_bad"), F.count_if(_is("beacon", "probe_response")).alias("n_scan"),
        F.count_if(auth).alias("n_auth"), F.count_if(auth & (c("status_code") == 0)).alias("n_auth_ok"), F.count_if(auth & (c("status_code") != 0)).alias("n_auth_bad"), _last(c("status_code"), auth & (c("status_code") != 0)).alias("bad_auth_status"),
        F.count_if(assoc).alias("n_assoc"), F.count_if(assoc & (c("status_code") == 0)).alias("n_assoc_ok"), _last(c("status_code"), assoc).alias("assoc_status"), F.count_if(_is("assoc_request")).alias("n_assoc_request"), F.count_if(data & ~eapol).alias("n_plain_data"),
        _first(c("rssi_dbm"), rssi).alias("rssi_first"), _last(c("rssi_dbm"), rssi).alias("rssi_last"), F.min("rssi_dbm").alias("rssi_min"), F.avg("rssi_dbm").alias("rssi_mean"), F.count("rssi_dbm").alias("n_rssi"),
        (F.avg(F.when(head, c("rssi_dbm"))) - F.avg(F.when(tail, c("rssi_dbm")))).alias("rssi_thirds_drop"), F.avg(F.when(head, c("rssi_dbm"))).alias("rssi_head"), F.avg(F.when(tail, c("rssi_dbm"))).alias("rssi_tail"),
        _first(c("ssid"), ~F.coalesce(c("ssid"), F.lit("")).isin("", "<hidden>")).alias("ssid"), _first(c("rsn_akm"), F.coalesce(c("rsn_akm"), F.lit("")) != "").alias("akm"), F.count_if(_is("eapol_m3") & (t >= c("_m4"))).alias("m3_after_m4"),
        F.transform(F.array_sort(F.collect_list(F.when(step, F.struct("frame_index", "addr1")))), lambda x: x["addr1"]).alias("roams"), F.min(F.when(m3, c("replay_counter"))).alias("m3_least"), F.max(F.when(m3, c("replay_counter"))).alias("m3_most"), F.bool_or(m3 & F.coalesce(c("_counter") > c("replay_counter"), F.lit(False))).alias("m3_falls"),
        F.collect_set(F.when(gone & c("reason_code").isNotNull(), F.struct(c("reason_code").alias("reason"), c("_reasons").alias("n")))).alias("gone_reasons"),
        F.min(F.when(_is("probe_request"), t)).alias("t_probe"), F.min(F.when(_is("beacon", "probe_response"), t)).alias("t_beacon"), F.min(F.when(_is("auth", "sae_commit"), t)).alias("t_auth"), F.max(F.when(_is("auth", "sae_confirm"), t)).alias("t_auth_end"),
        F.min(F.when(_is("assoc_request", "reassoc_request"), t)).alias("t_assoc"), F.min(F.when(assoc, t)).alias("t_assoc_end"), F.min(F.when(_is("eapol_m1"), t)).alias("t_m1"), F.max(F.when(_is("eapol_m4"), t)).alias("t_m4"), F.max(F.when(_is("eapol_m1", "eapol_m2", "eapol_m3", "eapol_m4"), t)).alias("t_eapol"),
        F.map_filter(F.create_map(*(x for k in f.KINDS for x in (F.lit(k), F.count_if(_is(k))))), lambda _, n: n > 0).alias("by_kind"),
    ).withColumn("retry_rate", F.when(c("n_data_frames") > 0, c("data_retries") / c("n_data_frames")).otherwise(0.0))


def capture_summary(frames: DataFrame) -> DataFrame:
    """The headline numbers of each capture, with its frames of each kind that it has (by_kind)."""
    return capture_facts(frames).select("capture_id", "n_frames", "duration_s", "n_data_frames", "retry_rate", "rssi_first", "rssi_last", "ssid", "akm", "n_deauth", "n_eapol", "by_kind")


def bssid_ranking(frames: DataFrame) -> DataFrame:
    """Management addresses by frequency, the first seen among equals."""
    own = frames.where("ftype = 0 and addr3 is not null and addr3 <> ''").groupBy("capture_id", "addr3").agg(F.count("*").alias("n"), F.min("frame_index").alias("first"))
    return own.withColumn("rank", F.row_number().over(W.partitionBy("capture_id").orderBy(F.desc("n"), "first")))


def stage_timings(facts: DataFrame) -> DataFrame:
    """A row for each stage whose bracket frames are there and in order."""
    c = F.col
    stages = (("scan", "t_probe", "t_beacon"), ("authentication", "t_auth", "t_auth_end"), ("association", "t_assoc", "t_assoc_end"), ("4-way handshake", "t_m1", "_end"), ("scan->auth latency", "t_probe", "t_auth"))
    rows = facts.withColumn("_end", F.coalesce("t_m4", "t_eapol"))
    each = F.array(*(F.struct(F.lit(name).alias("stage"), c(a).alias("start_s"), c(b).alias("end_s")) for name, a, b in stages))
    return rows.select("capture_id", F.inline(F.filter(each, lambda x: x["end_s"] >= x["start_s"]))).withColumn("duration_ms", ((c("end_s") - c("start_s")) * 1000).cast("int"))


def slowest_stage(timings: DataFrame) -> DataFrame:
    """The longest stage of each capture, the first among equals."""
    order = F.array_position(F.array(*map(F.lit, ("scan", "authentication", "association", "4-way handshake", "scan->auth latency"))), F.col("stage"))
    return timings.groupBy("capture_id").agg(F.max_by("stage", F.struct("duration_ms", -order)).alias("stage"), F.max("duration_ms").alias("duration_ms"))


def roam_sequence(frames: DataFrame) -> DataFrame:
    """The access points that a station asked for, one after the other, and whether one comes again."""
    asked = with_kind(frames).where(_is("assoc_request", "reassoc_request") & (F.coalesce("addr1", F.lit("")) != ""))
    steps = asked.withColumn("_was", F.lag("addr1").over(by_frame())).where("_was is null or _was <> addr1")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "addr1"))), lambda x: x["addr1"])
    out = steps.groupBy("capture_id").agg(ordered.alias("sequence"))
    return out.withColumns({"transitions": F.size("sequence") - 1, "pingpong": F.size(F.array_distinct("sequence")) < F.size("sequence")})


def _finding(name: str, when: Column, severity: Column | str, value: Column, detail: Column) -> Column:
    """An array of the finding, empty unless when."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    one = F.struct(F.lit(name).alias("detector"), severity.alias("severity"), value.cast("double").alias("value"), F.coalesce(detail, F.lit("")).alias("detail"))
    return F.filter(F.array(one), lambda x: F.coalesce(when, F.lit(False)))


def _excessive_retries() -> Column:
    c = F.col("retry_rate")
    return _finding("excessive_retries", (F.col("n_data_frames") >= 10) & (c >= 0.20), F.when(c >= 0.40, "critical").otherwise("warning"), c, F.concat(F.col("data_retries"), F.lit("/"), F.col("n_data_frames")))


def _weak_signal() -> Column:
    c = F.col("rssi_min")
    return _finding("weak_signal", c <= -80, F.when(c <= -88, "critical").otherwise("warning"), c, F.format_string("mean %.6f", "rssi_mean"))


def _rssi_collapse() -> Column:
    c = F.col("rssi_thirds_drop")
    return _finding("rssi_collapse", (F.col("n_rssi") >= 8) & (c >= 12), F.when(F.col("n_deauth") > 0, "critical").otherwise("warning"), c, F.lit(""))


def _deauth_flood() -> Column:
    """With the time from the first to the last, and how often each reason was given."""
    reasons = F.array_join(F.transform(F.array_sort("gone_reasons"), lambda x: F.concat(x["reason"], F.lit(":"), x["n"])), " ")
    return _finding("deauth_flood", F.col("n_deauth") >= 5, "critical", F.col("n_deauth"), F.concat_ws(" ", F.format_string("%.2f s", "deauth_window_s"), F.nullif(reasons, F.lit(""))))


def _eapol_retransmissions() -> Column:
    """A finding for each message seen more than twice, with who stopped answering."""
    of = lambda i: _finding("eapol_retransmission", F.col(f"m{i}") > 2, "critical", F.col(f"m{i}"), F.lit(f"M{i} " + ("station" if i % 2 else "AP")))
    return F.concat(*map(of, (1, 2, 3, 4)))


def _key_reinstallation() -> Column:
    """M3 again after the handshake was complete, and whether the replay counters increase."""
    up = (F.col("m3_least") < F.col("m3_most")) & ~F.col("m3_falls")
    return _finding("key_reinstallation", (F.col("m3") >= 2) & (F.col("m4") > 0) & (F.col("m3_after_m4") > 0), "critical", F.col("m3_after_m4"), F.when(up, "increasing").otherwise("not increasing"))


def _incomplete_handshake() -> Column:
    c = F.col
    missing = F.array_compact(F.array(*(F.when(c(f"m{i}") == 0, F.lit(f"M{i}")) for i in (1, 2, 3, 4))))
    return _finding("incomplete_handshake", ((c("m1") > 0) | (c("m2") > 0)) & ~((c("m3") > 0) & (c("m4") > 0)), "critical", F.lit(0.0), F.array_join(missing, ", "))


def _roam_churn() -> Column:
    many = F.size("roams") - 1
    again = F.size(F.array_distinct("roams")) < F.size("roams")
    return _finding("roam_churn", many >= 3, F.when(again, "critical").otherwise("warning"), many, F.array_join("roams", " > "))


def _bad_fcs() -> Column:
    rate = F.col("n_bad") / F.col("n_frames")
    return _finding("bad_fcs", (F.col("n_bad") > 0) & (rate >= 0.05), F.when(rate < 0.20, "warning").otherwise("critical"), rate, F.lit(""))


def _unprotected_mgmt() -> Column:
    own = F.col("akm").isNotNull() & ~F.col("akm").isin("SAE", "FT-SAE", "OWE") & (F.col("n_unprotected") > 0)
    return _finding("unprotected_management_frames", own, "info", F.col("n_unprotected"), F.col("akm"))


FINDINGS = (_excessive_retries, _weak_signal, _rssi_collapse, _deauth_flood, _eapol_retransmissions, _key_reinstallation, _incomplete_handshake, _roam_churn, _bad_fcs, _unprotected_mgmt)


def found(facts: DataFrame, *findings) -> DataFrame:
    """capture_id, detector, severity, value, detail: what the given findings (all by default) make of each capture, in one projection."""
    return facts.select("capture_id", F.inline(F.concat(*(f() for f in findings or FINDINGS))))


def detect_excessive_retries(facts: DataFrame) -> DataFrame:
    return found(facts, _excessive_retries)


def detect_weak_signal(facts: DataFrame) -> DataFrame:
    return found(facts, _weak_signal)


def detect_rssi_collapse(facts: DataFrame) -> DataFrame:
    return found(facts, _rssi_collapse)


def detect_deauth_flood(facts: DataFrame) -> DataFrame:
    return found(facts, _deauth_flood)


def detect_eapol_retransmissions(facts: DataFrame) -> DataFrame:
    return found(facts, _eapol_retransmissions)


def detect_key_reinstallation(facts: DataFrame) -> DataFrame:
    return found(facts, _key_reinstallation)


def detect_incomplete_handshake(facts: DataFrame) -> DataFrame:
    return found(facts, _incomplete_handshake)


def detect_roam_churn(facts: DataFrame) -> DataFrame:
    return found(facts, _roam_churn)


def detect_bad_fcs(facts: DataFrame) -> DataFrame:
    return found(facts, _bad_fcs)


def detect_unprotected_mgmt(facts: DataFrame) -> DataFrame:
    return found(facts, _unprotected_mgmt)


def scan_captures(frames: DataFrame) -> DataFrame:
    """The findings of all detectors: one reading of the frames, one shuffle, one aggregate."""
    return found(capture_facts(frames))


def rank_anomalies(found: DataFrame) -> DataFrame:
    """The findings of each capture, the worst first, then in the order of the detectors."""
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    w = W.partitionBy("capture_id").orderBy(place(SEVERITIES, "severity"), place(DETECTORS, "detector"), "detail")
    return found.withColumn("rank", F.row_number().over(w))


def connection_forensics(facts: DataFrame) -> DataFrame:
    """stage_reached, rule (1 to 13: the first that fits), sub (a, b, c: its case), failed_at, succeeded, status and reason code of each capture."""
    c = F.col
    stage = F.when(c("n_plain_data") > 0, 5).when((c("m3") > 0) & (c("m4") > 0), 4).when(c("n_assoc_ok") > 0, 3).when(c("n_auth_ok") > 0, 2).when(c("n_scan") > 0, 1).otherwise(0)
    rows = facts.withColumn("stage_rank", stage)
    up = c("stage_rank") >= 4
    shaken = (c("stage_rank") == 3) & ((c("m1") > 0) | (c("m2") > 0))
    graceful = up & (c("n_deauth") > 0) & c("last_reason").isin(*f.GRACEFUL)
    rule = (
        F.when(c("n_frames") == 0, 1).when(c("n_scan") == 0, 2).when(c("n_auth") == 0, 3).when((c("n_auth_bad") > 0) & (c("n_assoc") == 0), 4)
        .when((c("n_assoc") == 0) & (c("n_assoc_request") == 0), 5).when((c("n_assoc") > 0) & (c("n_assoc_ok") == 0), 6)
        .when(shaken, 7).when(F.coalesce(graceful, F.lit(False)), 8).when(up & (c("n_deauth") > 0), 9).when(c("stage_rank") == 5, 10).when(c("stage_rank") == 4, 11).when(c("stage_rank") == 3, 12).otherwise(13)
    )
    rows = rows.withColumn("rule", rule)
    seven = F.when((c("m1") > 0) & (c("m2") == 0), "no M2").when((c("m2") > 0) & (c("m3") == 0), F.when(c("last_reason") == 23, "no M3, credentials").when(c("last_reason") == 15, "no M3, timeout").otherwise("no M3")).when((c("m3") > 0) & (c("m4") == 0), "no M4").otherwise("")
    sub = F.when(c("rule") == 7, seven).when(c("rule") == 9, F.when(c("last_reason") == 34, "beacon loss").otherwise("torn down")).when(c("rule") == 12, F.when(c("akm").isNull(), "open").otherwise("handshake missing")).otherwise("")
    rows = rows.withColumn("case", sub)
    ok = c("rule").isin(8, 10, 11) | ((c("rule") == 12) & (c("case") == "open"))
    names = F.array(*map(F.lit, f.STAGES))
    failed = F.when(c("rule").isin(1, 2), "nothing").when(c("rule").isin(3, 4, 5), "scanned").when(c("rule") == 6, "authenticated").when((c("rule") == 7) & (c("case") != ""), "associated").when(c("rule") == 9, F.get(names, c("stage_rank"))).when((c("rule") == 12) & (c("case") != "open"), "associated")
    status = F.when(c("rule") == 4, c("bad_auth_status")).when((c("n_assoc") > 0) & (c("n_assoc_ok") == 0), c("assoc_status"))
    seen = F.array_compact(F.array(*(F.when(c(f"m{i}") == 1, F.lit(f"M{i}")).when(c(f"m{i}") > 1, F.concat(F.lit(f"M{i}x"), c(f"m{i}"))) for i in (1, 2, 3, 4))))
    evidence = F.array_compact(F.array(
        F.when(c("rule") == 2, F.concat(c("n_frames"), F.lit(" frames, none from an AP"))), F.when(c("rule") == 5, F.concat(c("n_auth"), F.lit(" auth frames, no association"))), F.when((c("rule") == 7) & (c("m2") > 0) & (c("m3") == 0), F.concat(F.lit("M2 sent "), c("m2"), F.lit(" times, no M3"))),
        F.when(c("rule").isin(8, 10) & (c("retry_rate") > 0.20), F.lit("retry rate over 20%")), F.when(c("rule").isin(8, 9) & (c("rssi_last") < -80), F.concat(F.lit("signal ended at "), c("rssi_last"), F.lit(" dBm"))),
    ))
    return rows.withColumns({"stage_reached": F.get(names, c("stage_rank")), "succeeded": ok, "failed_at": failed, "status_code": status, "reason_code": c("last_reason"), "eapol_seen": F.array_join(seen, " "), "evidence": evidence})


def verdict_text(rule: Column, case: Column) -> Column:
    """A short verdict of each rule."""
    said = {1: "empty capture", 2: "the AP was never heard", 3: "no authentication was attempted", 4: "authentication rejected", 5: "authentication timed out", 6: "association rejected", 7: "handshake incomplete", 8: "connected and closed cleanly", 9: "connected, then lost", 10: "connected and passed data", 11: "connected, no data seen", 12: "associated", 13: "no further diagnosis"}
    return F.concat_ws(" - ", f.choose(rule, said, F.lit("")), F.nullif(case, F.lit("")))


def reconcile_frames(ours: DataFrame, theirs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A row for each field of each frame in which two dissections differ (nulls compare equal), and for each frame that only one has (field: frame)."""
    keys = ["capture_id", "frame_index"]
    a = ours.select(*keys, F.struct(*fields).alias("a"))
    b = theirs.select(*keys, F.struct(*fields).alias("b"))
    both = a.join(b, keys, "full_outer")
    text = lambda side, x: F.col(f"{side}.{x}").cast("string")
    missing = F.col("a").isNull() | F.col("b").isNull()
    differ = [F.when(~missing & ~text("a", x).eqNullSafe(text("b", x)), F.struct(F.lit(x).alias("field"), text("a", x).alias("ours"), text("b", x).alias("theirs"))) for x in fields]
    lone = F.when(missing, F.struct(F.lit("frame").alias("field"), F.when(F.col("a").isNotNull(), "seen").alias("ours"), F.when(F.col("b").isNotNull(), "seen").alias("theirs")))
    return both.select(*keys, F.inline(F.array_compact(F.array(lone, *differ))))


#: The type and subtype by which another dissector calls a kind.
SUBTYPES = {"assoc_request": 0, "assoc_response": 1, "reassoc_request": 2, "reassoc_response": 3, "probe_request": 4, "probe_response": 5, "beacon": 8, "disassoc": 10, "auth": 11, "sae_commit": 11, "sae_confirm": 11, "deauth": 12}
#: What a dissector's table of fields is read as: all text, as it prints them.
DISSECTED = ("type_subtype", "retry", "status_code", "reason_code", "ssid", "rssi", "eapol", "malformed")


def _printed_int(text: Column) -> Column:
    """A number printed as decimal or as 0x hex, null if it is neither."""
    return F.when(text.startswith("0x"), F.conv(F.nullif(F.regexp_extract(text, "^0x([0-9a-fA-F]+)$", 1), F.lit("")), 16, 10)).otherwise(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)\s*$", 1), F.lit(""))).try_cast("long")


def reconcile_dissections(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """capture_id, frame_index, field, ours, theirs wherever frames differ from what another dissector printed: theirs has capture_id, frame_index and the texts of DISSECTED (null or empty: it printed none). What only one of them says is no difference, but for whether a frame is EAPOL. An SSID may be printed as hex, a signal as one value for each antenna, of which the first counts; a text that is no number is passed over."""
    c = F.col
    own = with_kind(ours).select("capture_id", "frame_index", "kind", "status_code", "reason_code", "ssid", "retry", "rssi_dbm", c("key_info").isNotNull().alias("is_eapol"))
    said = theirs.select("capture_id", "frame_index", *(F.coalesce(c(x).cast("string"), F.lit("")).alias(f"t_{x}") for x in DISSECTED))
    both = own.join(said, ["capture_id", "frame_index"])
    hexed = F.when((F.length("t_ssid") % 2 == 0) & c("t_ssid").rlike("^[0-9a-fA-F]+$"), F.make_valid_utf8(F.unhex("t_ssid").cast("string")))
    known = f.choose(c("kind"), SUBTYPES, F.lit(None).cast("int")).cast("long")
    compared = {
        "type_subtype": (known, _printed_int(c("t_type_subtype"))), "status_code": (c("status_code").cast("long"), _printed_int(c("t_status_code"))), "reason_code": (c("reason_code").cast("long"), _printed_int(c("t_reason_code"))),
        "ssid": (F.when(c("ssid") != "<hidden>", F.nullif(c("ssid"), F.lit(""))), F.nullif(F.coalesce(hexed, c("t_ssid")), F.lit(""))), "retry": (c("retry"), F.when(c("t_retry").isin("0", "1"), c("t_retry") == "1")),
        "rssi_dbm": (c("rssi_dbm").cast("long"), _printed_int(F.get(F.split("t_rssi", ","), F.lit(0)))), "is_eapol": (c("is_eapol"), c("t_eapol") != ""),
    }
    rows = [F.when(a.isNotNull() & b.isNotNull() & (a != b), F.struct(F.lit(name).alias("field"), a.cast("string").alias("ours"), b.cast("string").alias("theirs"))) for name, (a, b) in compared.items()]
    return both.select("capture_id", "frame_index", F.inline(F.array_compact(F.array(*rows))))


def reconciled_captures(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """capture_id, n_ours, n_theirs, n_differences, malformed (the frames that the other dissector calls so, in order) and agrees: as many frames, and no difference. A capture that one of them lacks has 0 frames there."""
    c = F.col
    differ = reconcile_dissections(ours, theirs).groupBy("capture_id").agg(F.count("*").alias("n_differences"))
    bad = F.array_sort(F.collect_list(F.when(F.coalesce(c("malformed").cast("string"), F.lit("")) != "", c("frame_index"))))
    mine = ours.groupBy("capture_id").agg(F.count("*").alias("n_ours"))
    other = theirs.groupBy("capture_id").agg(F.count("*").alias("n_theirs"), bad.alias("malformed"))
    out = mine.join(other, "capture_id", "full_outer").join(differ, "capture_id", "left")
    out = out.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_ours", "n_theirs", "n_differences")} | {"malformed": F.coalesce("malformed", F.array().cast(dict(other.dtypes)["malformed"]))})
    return out.withColumn("agrees", (c("n_ours") == c("n_theirs")) & (c("n_differences") == 0))


def _next_far(ms: np.ndarray, at: int, end: int, from_ms: int) -> int:
    """The first place from at to end whose clock is 1 s or more after from_ms, or end."""
    step = 64
    while at < end:
        far = np.flatnonzero(ms[at : min(end, at + step)] - from_ms >= 1000)
        if len(far):
            return at + int(far[0])
        at, step = at + step, 2 * step
    return end


def collapse_data_frames(frames: DataFrame) -> DataFrame:
    """Runs of data frames, closed by any other frame or after the frame 1 s or more from the run's first: n, retries, their share, and a warning over 20%. The cut is greedy, so frames go in order through one task of their capture, a batch at a time: only the bucket that is open is carried on. Frames without a clock open none and close none."""
    ship(frames.sparkSession)
    c = F.col
    rows = with_kind(frames).select("capture_id", c("frame_index").cast("long").alias("frame_index"), (c("time_s") * 1000).cast("long").alias("ms"), ((c("ftype") == 2) & c("key_info").isNull()).alias("data"), F.coalesce(c("retry"), F.lit(False)).cast("long").alias("retry"))
    rows = rows.where("ms is not null or not coalesce(data, false)").withColumns({"data": F.coalesce("data", F.lit(False)), "ms": F.coalesce("ms", F.lit(0))})
    kind = dict(frames.dtypes)

    types = to_arrow_schema(rows.select("capture_id", "frame_index", c("ms").alias("monotonic_ms"), c("ms").alias("n"), c("ms").alias("retries")).schema)

    def told(buckets: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in buckets], types.field(k).type) for k, i in enumerate((0, 1, 3, 4, 5))], types.names)

    def cut(batches):
        held: list | None = None  # capture, first frame, its clock, least clock, n, retries
        for b in batches:
            capture = b.column(0).dictionary_encode()
            code = capture.indices.fill_null(-1).to_numpy()
            index, ms, data, retry = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            value = lambda i: capture.dictionary[int(code[i])].as_py() if code[i] >= 0 else None  # noqa: B023, E731
            # runs end where another frame or another capture comes
            breaks = np.flatnonzero(~data | (np.diff(code, prepend=code[:1]) != 0))
            ends = np.append(breaks, len(code))
            total, out, at = np.concatenate([[0], np.cumsum(retry)]), [], 0
            while at < len(code):
                if not data[at]:
                    if held:
                        out.append(held)
                    held, at = None, at + 1
                    continue
                if held and held[0] != value(at):
                    out.append(held)
                    held = None
                fresh = held is None
                end = int(ends[np.searchsorted(ends, at, "right")])
                start = int(ms[at]) if fresh else held[2]
                last = _next_far(ms, at, end, start)
                upto = min(last + 1, end)
                least = int(ms[at:upto].min())
                n, again = upto - at, int(total[upto] - total[at])
                held = [value(at), int(index[at]), start, least, n, again] if fresh else [*held[:3], min(held[3], least), held[4] + n, held[5] + again]
                if last < end:
                    out.append(held)
                    held = None
                at = upto
            if out:
                yield told(out)
        if held:
            yield told([held])

    out = rows.repartition("capture_id").sortWithinPartitions("capture_id", "frame_index").mapInArrow(cut, f"capture_id {kind['capture_id']}, frame_index long, monotonic_ms long, n long, retries long")
    share = c("retries") / c("n")
    return out.withColumns({"frame_index": c("frame_index").cast(kind["frame_index"]), "retry_share": share, "severity": F.when(share > 0.2, "warning").otherwise("info")})
