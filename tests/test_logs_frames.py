"""Log lines, captures and triage on literals."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavelake.functions import logs as f
from wavelake.operators import failures as fa
from wavelake.operators import frames as fr
from wavelake.operators import logs as op
from wavelake.operators import timeline as tl
from wavelake.operators import triage as tr

#: A fixed value: a line in the simulator's format.
SIM = "2025-01-01T00:00:01.240Z [   1240ms] <NOTICE> wifid     : assoc resp status=0 aid=19 bssid=be:14:66:79:d2:d6 elapsed_ms=16"


def raw(spark, *lines):
    return spark.createDataFrame([("t", i + 1, x) for i, x in enumerate(lines)], "tag string, line_no int, raw string")


def test_mixed(spark):
    got = op.parse_mixed_log(raw(spark, SIM, "Traceback:", "  File x", "", "2026-09-25 14:32:01.123 Df wifid[123:456] [com.apple.wifi:Client] scan complete networks=2")).orderBy("line_no").collect()
    assert [(r.monotonic_ms, r.level, r.component) for r in got] == [(1240, "NOTICE", "wifid"), (1240, "INFO", "unparsed"), (1240, "INFO", "unparsed"), (0, "DEBUG", "wifid")]
    assert got[0].fields["status"] == "0" and got[0].fields["aid"] == "19" and got[3].fields == {"networks": "2"}


def test_unparsed_lines_are_stripped(spark):
    got = op.parse_mixed_log(raw(spark, "  \tindented  ", SIM)).orderBy("line_no").collect()
    assert got[0].message == "indented" and got[0].raw == "  \tindented  "


def test_summary_and_path(spark):
    move = "2025-01-01T00:00:01.240Z [   {:4d}ms] <NOTICE> wifid     : state transition from=S{} event=E to=S{}"
    got = op.log_summary(op.parse_mixed_log(raw(spark, *(move.format(i, i, i + 1) for i in range(9)), SIM.replace("status=0", "status=17"), "  other"))).first()
    assert (got.total, got.n_transitions, got.path, got.final_state, list(got.status_codes), got.by_component) == (11, 9, "S4>S5>S6>S7>S8>S9", "S9", [17], {"unparsed": 1, "wifid": 10})


def test_match_is_the_best_template(spark):
    """Against all templates of the length, in plain code."""
    import random

    rnd = random.Random(2)
    lines = [" ".join(rnd.choice(["alpha", "beta", "gamma", "12", "x=3", "<q>"]) for _ in range(rnd.randint(1, 5))) for _ in range(150)]
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines)], "tag string, line_no int, message string")
    templates = op.drain_templates(rows.where("line_no < 60"), max_children=3)
    known = [(r.template_id, list(r.tokens), r.key1, r.key2) for r in templates.collect()]
    got = {r.line_no: r.template_id for r in op.match_template(rows, templates).collect()}
    tokens = {r.line_no: list(r.t) for r in rows.select("line_no", f.tokens(F.col("message")).alias("t")).collect()}
    for i, t in tokens.items():
        fits = lambda key, j: key in ("<*>", t[j] if j < len(t) else "")  # noqa: B023, E731
        able = [(sum(a in (b, "<*>") for a, b in zip(p, t, strict=True)) / len(t), -n) for n, p, k1, k2 in known if len(p) == len(t) and fits(k1, 0) and fits(k2, 1)]
        best = max((x for x in able if x[0] >= 0.5), default=None)
        assert got[i] == (-best[1] if best else None), t


def test_fields_and_masks(spark):
    one = lambda text, g: spark.createDataFrame([(text,)], "m string").select(g(F.col("m"))).first()[0]
    assert one('ssid="my network" channel=36 channel=40', f.extract_fields) == {"ssid": "my network", "channel": "40"}
    assert one("be:14:66:79:d2:d6 10.0.0.1 0xff 12 1.5", f.mask) == "<MAC> <IP> <HEX> <NUM> <FLOAT>"
    assert one("a  seed=4 aid=9 rssi=-60 10.0.0.1 b", f.scrub) == "a b"


def mined(spark, lines, **options):
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines)], "tag string, line_no int, message string")
    return op.drain_templates(rows, **options)


def test_drain(spark):
    one = mined(spark, [f"assoc resp aid={i} bssid=02:00:00:00:00:{i:02x}" for i in range(50)]).collect()
    assert [r.hits for r in one] == [50] and len(one[0].examples) <= 3
    assert mined(spark, ["scan started now", "link is up", "lease from server ok"]).count() == 3
    pair = mined(spark, ["auth algo OPEN done", "auth algo SAE done"]).collect()
    assert len(pair) == 1 and "<*>" in pair[0].tokens
    assert mined(spark, [f"tok{chr(97 + i % 26)}{chr(97 + i // 26)} common text here" for i in range(200)], max_children=4).count() < 200


FRAME = "capture_id string, frame_index int, time_s double, ftype int, subtype int, addr1 string, addr2 string, addr3 string, retry boolean, protected boolean, bad_fcs boolean, rssi_dbm int, ssid string, status_code int, reason_code int, auth_algo int, auth_seq int, key_info int, replay_counter long, rsn_akm string"
KEYS = {"m1": 138, "m2": 266, "m3": 5066, "m4": 778}


def capture(spark, name, kinds, reason=None, akm="PSK"):
    rows, replay = [], 1
    for i, k in enumerate(kinds):
        sub = {"beacon": 8, "auth": 11, "areq": 0, "aresp": 1, "deauth": 12}.get(k, 8)
        key = KEYS.get(k)
        replay += k == "m3"
        rows.append((name, i, i * 0.1, 2 if key or k == "data" else 0, sub, "ap", "sta", "ap", False, False, False, -50, "net" if k == "beacon" else None, 0 if k in ("auth", "aresp") else None, reason if k == "deauth" else None, 0 if k == "auth" else None, 1 if k == "auth" else None, key, replay if key else None, akm if k == "beacon" else None))
    return spark.createDataFrame(rows, FRAME)


def test_forensics(spark):
    start = ["beacon", "auth", "areq", "aresp"]
    cases = {"healthy": (start + ["m1", "m2", "m3", "m4", "data", "deauth"], 3), "timeout": (start + ["m1", "m2", "m2", "deauth"], 15), "pmk": (start + ["m1", "m2", "deauth"], 23), "silent": (["beacon", "auth"], None), "deaf": (["data"], None)}
    df = None
    for name, (kinds, reason) in cases.items():
        one = capture(spark, name, kinds, reason)
        df = one if df is None else df.unionByName(one)
    got = {r.capture_id: r for r in fr.connection_forensics(fr.capture_facts(df)).collect()}
    assert {k: (r.rule, r.stage_reached, r.succeeded) for k, r in got.items()} == {"healthy": (8, "data", True), "timeout": (7, "associated", False), "pmk": (7, "associated", False), "silent": (5, "authenticated", False), "deaf": (2, "data", False)}
    assert got["timeout"]["case"] == "no M3, timeout" and got["pmk"]["case"] == "no M3, credentials"


def test_detectors(spark):
    flood = capture(spark, "flood", ["beacon"] + ["deauth"] * 20, 7)
    again = capture(spark, "again", ["beacon", "m1", "m2", "m3", "m4", "m3", "m3", "m3", "m3"])
    fine = capture(spark, "fine", ["beacon", "auth", "areq", "aresp", "m1", "m2", "m3", "m4"] + ["data"] * 12)
    found = {(r.capture_id, r.detector, r.severity): r for r in fr.scan_captures(flood.unionByName(again).unionByName(fine)).collect()}
    assert ("flood", "deauth_flood", "critical") in found and ("flood", "unprotected_management_frames", "info") in found
    assert found["again", "key_reinstallation", "critical"].detail == "increasing"
    assert not any(k[0] == "fine" and k[2] == "critical" for k in found)
    assert found["flood", "deauth_flood", "critical"].detail == "1.90 s 7:20"
    plan = fr.scan_captures(fine)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_buckets(spark):
    ms = [0, 400, 999, 1000, 1100, 1900, 2200, 5000]
    rows = [("c", i, t / 1000, 2, 8, None, None, None, i % 2 == 0, False, False, None, None, None, None, None, None, None, None, None) for i, t in enumerate(ms)]
    got = fr.collapse_data_frames(spark.createDataFrame(rows, FRAME)).orderBy("frame_index").collect()
    assert [(r.monotonic_ms, r.n) for r in got] == [(0, 4), (1100, 3), (5000, 1)]


def test_buckets_against_a_fold(spark):
    """Random runs of several captures, with clocks that go back, cut by small batches; and one capture of very many frames."""
    import random

    rnd = random.Random(5)
    rows, want = [], []
    for cap in ("a", "b", None, "d"):
        t, run = 0, None
        for i in range(400):
            t += rnd.choice([0, 5, 90, 400, 700, 1500, -300, -2000])
            data, retry = rnd.random() < 0.93, rnd.random() < 0.3
            rows.append((cap, i, t / 1000, 2 if data else 0, 8, None, None, None, retry, False, False, None, None, None, None, None, None, None, None, None))
            if not data:
                run = None
                continue
            ms = int(t / 1000 * 1000)
            if run is None:
                run = [cap, i, ms, 0, 0, ms]
                want.append(run)
            run[2], run[3], run[4] = min(run[2], ms), run[3] + 1, run[4] + retry
            if ms - run[5] >= 1000:
                run = None
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "37")
    try:
        got = fr.collapse_data_frames(spark.createDataFrame(rows, FRAME).repartition(5))
        assert sorted(((r.capture_id, r.frame_index, r.monotonic_ms, r.n, r.retries) for r in got.collect()), key=str) == sorted((tuple(w[:5]) for w in want), key=str)
    finally:
        spark.conf.set(key, was)
    one = spark.range(2_000_000).select(F.lit("c").alias("capture_id"), F.col("id").cast("int").alias("frame_index"), (F.col("id") / 1000).alias("time_s"), F.lit(2).alias("ftype"), F.lit(8).alias("subtype"), *(F.lit(None).cast("int").alias(x) for x in ("auth_algo", "auth_seq", "key_info")), (F.col("id") % 4 == 0).alias("retry"))
    totals = fr.collapse_data_frames(one).agg(F.count("*"), F.sum("n"), F.max("n"), F.sum("retries")).first()
    assert tuple(totals)[1:] == (2_000_000, 1001, 500_000) and 1998 <= totals[0] <= 1999


def stream(n, kinds, seed):
    """Statements of 16 tokens of some kinds, each of which has words of its own and up to four places that vary."""
    import random

    rnd = random.Random(seed)
    shapes = [["link", "state", *(f"w{chr(97 + k)}{chr(97 + i)}" for i in range(14))] for k in range(kinds)]
    for s in shapes:
        for i in rnd.sample(range(2, 16), rnd.randint(0, 4)):
            s[i] = None
    return [("t", i + 1, " ".join(w or f"v{rnd.randrange(10**6)}x" for w in rnd.choice(shapes))) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_templates_in_chunks(spark, seed):
    """One pass over a leaf, and chunks of it merged: the same templates, hits and first lines on random streams."""
    df = spark.createDataFrame(stream(3000, 12, seed), "tag string, line_no int, message string")
    told = lambda x: sorted((tuple(r.tokens), r.hits, r["first"].line_no) for r in x.collect())
    assert told(op.drain_templates(df, chunk=100)) == told(op.drain_templates(df, chunk=10**6))


def test_chunks_of_templates_that_run_into_each_other(spark):
    """Where statements are as like to several templates, chunks can differ from one pass; measured: under 2 % of the lines in templates of other tokens."""
    import random
    from collections import Counter

    rnd = random.Random(3)
    rows = [("t", i + 1, "link state " + " ".join(rnd.choice(["up", "down", "slow", f"n{rnd.randrange(50)}x"]) for _ in range(6))) for i in range(3000)]
    df = spark.createDataFrame(rows, "tag string, line_no int, message string")
    a, b = (Counter({tuple(r.tokens): r.hits for r in op.drain_templates(df, chunk=n).collect()}) for n in (200, 10**6))
    assert sum(a.values()) == sum(b.values()) == 3000 and sum((a - b).values()) <= 60


def test_a_hot_leaf_is_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("t").alias("tag"), F.col("id").cast("int").alias("line_no"), F.format_string("link state of v%dx is w%dx now", F.col("id"), F.pmod(F.col("id") * 7919, F.lit(100_003))).alias("message"))
    (row,) = op.drain_templates(df).collect()
    assert row.hits == 200_000 and " ".join(row.tokens) == "link state of <*> is <*> now" and len(row.examples) == 3


def test_log_text_of_large_files(spark, tmp_path):
    """Files cut into many splits: order and numbers right, invalid bytes replaced, blank lines counted and left out."""
    import random

    from wavelake.sources import store

    rnd, want = random.Random(1), []
    for name in ("a.log", "b.log"):
        raw = [b"" if rnd.random() < 0.1 else f"{name} line {i} ".encode() + b"x" * rnd.randrange(200) + (b"\xff" if i % 1000 == 7 else b"") + "é".encode() for i in range(40_000)]
        (tmp_path / name).write_bytes(b"\n".join(raw) + (b"\n" if name == "a.log" else b""))
        want += [(name, i + 1, x.decode(errors="replace")) for i, x in enumerate(raw) if x]
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, str(256 << 10))
    try:
        got = store.read_log_text(spark, f"{tmp_path}/*.log")
        assert got.rdd.getNumPartitions() > 20
        assert sorted((r.path.rpartition("/")[2], r.line_no, r.raw) for r in got.collect()) == want
    finally:
        spark.conf.set(key, was)


def test_clusters(spark):
    bugs = ["4-way handshake timed out waiting for M3", "wrong passphrase PMK mismatch reason=23", "DHCPNAK received no address"]
    rows = [(f"t{i:02d}", bugs[i % 3], bugs[i % 3]) for i in range(18)]
    df = spark.createDataFrame(rows, "tag string, signature string, fault string")
    got = fa.cluster_failures(df)
    by = {r.tag: r.label for r in got.collect()}
    assert len(set(by.values())) == 3 and all(by[f"t{i:02d}"] == by[f"t{i % 3:02d}"] for i in range(18))
    s = fa.cluster_scores(got, df.select("tag", "fault")).first()
    assert (s.homogeneity, s.completeness, s.ari) == (1.0, 1.0, 1.0)
    assert fa.cluster_failures(df.limit(1)).count() == 0
    assert fa.cluster_failures(df.withColumn("signature", F.lit(" "))).count() == 0


@pytest.mark.parametrize("min_samples,block", [(1, 5), (2, 5), (3, 7), (4, 512)])
def test_clusters_against_plain_dbscan(spark, monkeypatch, min_samples, block):
    """Weights over all rows, cosines, cores and borders in plain code on whole signatures, some of which repeat."""
    monkeypatch.setattr(fa.cosine, "BLOCK", block)
    import math
    import random
    from collections import Counter

    rnd = random.Random(7)
    words = "auth timeout handshake m3 deauth reason dhcp nak beacon loss link weak scan empty final_state path".split()
    base = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(8)]
    texts = {}
    for i in range(48):
        w = base[i % 8].split()
        for _ in range(rnd.choice([0, 1, 3, 8, 20])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts[f"t{i:02d}"] = " ".join(w)
    texts |= {f"u{i:02d}": texts["t03"] for i in range(6)}

    def grams(t):
        out = Counter()
        for w in t.lower().split():
            w = f" {w} "
            for n in (3, 4, 5):
                out.update([w[i : i + n] for i in range(len(w) - n + 1)] if len(w) > n else [w])
                if len(w) <= n:
                    break
        return out

    tf = {k: grams(t) for k, t in texts.items()}
    df = Counter(g for c in tf.values() for g in c)
    vec = {}
    for k in texts:
        v = {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in tf[k].items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vec[k] = {g: x / size for g, x in v.items()}
    near = lambda a, b: sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) >= 0.65 - 1e-12
    around = {k: [o for o in texts if near(k, o)] for k in texts}
    core = {k for k in texts if len(around[k]) >= min_samples}
    group: dict = {}
    for k in sorted(core):
        todo = [k] if k not in group else []
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = k
                todo += [o for o in around[x] if o in core]
    got = {r.tag: r.label for r in fa.cluster_failures(spark.createDataFrame(list(texts.items()), "tag string, signature string"), min_samples=min_samples).collect()}
    of = lambda keys: {frozenset(k for k in keys if got[k] == x) for x in {got[k] for k in keys}}
    assert of(core) == {frozenset(k for k in core if group[k] == x) for x in set(group.values())}
    for k in set(texts) - core:
        roots = {got[o] for o in around[k] if o in core}
        assert got[k] in roots if roots else got[k] == -1


@pytest.mark.parametrize("min_samples,rare", [(2, 2), (3, 12)])
def test_clusters_with_and_without_loose_vectors(spark, monkeypatch, min_samples, rare):
    """Some vectors meet by blocks and others through rare n-grams; all the rest of these tests have loose ones alone."""
    monkeypatch.setattr(fa.cosine, "RARE", rare)
    test_clusters_against_plain_dbscan(spark, monkeypatch, min_samples, 5)


def test_signatures_like_no_other_meet_in_no_block(spark):
    """3,000 hashes, of which two differ in two signs, and a bug of many wordings."""
    text = F.concat(F.lit("handshake timed out waiting for M3 step="), F.col("id") % 97)
    df = spark.range(3200).select(F.format_string("t%04d", "id").alias("tag"), F.when(F.col("id") < 3000, F.md5(F.col("id").cast("string"))).otherwise(text).alias("signature"))
    twin = df.where("tag = 't0007'").select(F.lit("u").alias("tag"), F.concat(F.substring("signature", 1, 30), F.lit("zz")).alias("signature"))
    df = df.unionByName(twin)
    reps = df.groupBy("signature").agg(F.min("tag").alias("tag"), F.count("*").alias("size"))
    _, pairs, places, loose = fa.cosine.blocks(fa.tfidf_char_ngrams(reps), 0.65)
    assert places.where("block % 2 = 1").count() > 2900 and pairs.count() <= 10
    assert [(r.a, r.b) for r in loose.where("b = 'u'").collect()] == [("t0007", "u")]
    got = {r.tag: r.label for r in fa.cluster_failures(df).collect()}
    assert got["u"] == got["t0007"] >= 0 and sum(x < 0 for x in got.values()) == 2999 and len({got[f"t{i}"] for i in range(3000, 3200)}) == 1


def test_weights_are_of_all_rows(spark):
    """100 equal signatures and one that differs in a word: what all share weighs little, so the one is noise."""
    rows = [(f"t{i:03d}", "handshake timed out waiting") for i in range(100)] + [("u", "handshake timed out never")]
    got = {r.tag: r.label for r in fa.cluster_failures(spark.createDataFrame(rows, "tag string, signature string")).collect()}
    assert got.pop("u") == -1 and set(got.values()) == {0}


def test_one_bug_of_many_signatures(spark):
    """20,000 different signatures of one bug and 200 of another: links are written by vector, not by pair."""
    detail = F.concat_ws(" ", *(F.concat(F.lit(f"step{i}="), F.pmod(F.floor(F.col("id") / 12**i), F.lit(12))) for i in range(4)))
    text = F.concat(F.lit("4-way handshake timed out waiting for M3 from the access point stage:associated path:SCANNING>AUTHENTICATING>ASSOCIATING degraded_weak_signal missing_m3 retransmitting "), detail)
    other = F.concat(F.lit("DHCPNAK received, no address was given to interface en0; lease refused by the upstream server of this subnet "), detail)
    df = spark.range(20_200).select(F.format_string("t%05d", "id").alias("tag"), F.when(F.col("id") < 20_000, text).otherwise(other).alias("signature"))
    got = fa.cluster_failures(df).groupBy("label").count().collect()
    assert sorted((r["label"], r["count"]) for r in got) == [(0, 20_000), (1, 200)]


def test_bundle(spark):
    capture_ = capture(spark, "c1", ["beacon", "auth"]).unionByName(capture(spark, "c2", ["beacon"]))
    facts = fr.capture_facts(capture_)
    lines = op.parse_mixed_log(raw(spark, SIM)).withColumn("tag", F.lit("c1"))
    window = spark.createDataFrame([], "tag string, monotonic_ms long, source_rank int, seq int, source string, label string, detail string")
    clusters = spark.createDataFrame([(f"c{i}", 0) for i in range(1, 9)], "tag string, label int")
    templates = spark.createDataFrame([("c1", "a <*>", 3), ("c1", "b", 9)], "tag string, text string, hits long")
    kpi = spark.createDataFrame([("c1", 1, "net0", "ok", ""), ("c1", 2, "net0", "critical", "z-score")], "tag string, id long, scope_key string, verdict string, reason string")
    got = {(r.tag, r.name): r.text for r in tr.failure_bundle(fr.connection_forensics(facts), window, fr.rank_anomalies(fr.found(facts)), op.log_summary(lines), templates, clusters, kpi).collect()}
    assert got["c1", "kpi"] == "net0 critical z-score" and got["c1", "templates"] == "x9 b\nx3 a <*>"
    assert got["c1", "cluster"] == "c2\nc3\nc4\nc5\nc6" and got["c8", "cluster"] == "c1\nc2\nc3\nc4\nc5" and got["c2", "forensics"]


def test_features_with_histogram(spark):
    facts = fr.capture_facts(capture(spark, "c1", ["beacon", "auth"]))
    lines = op.parse_mixed_log(raw(spark, SIM, SIM)).withColumn("tag", F.lit("c1"))
    histogram = op.template_histogram(op.match_template(lines, op.drain_templates(lines)))
    got = fa.failure_features(fr.connection_forensics(facts), op.log_summary(lines), facts, histogram).first()
    assert got.histogram == {1: 2} and got.n_log_lines == 2


def test_timeline_of_large_ids(spark):
    rows = spark.createDataFrame([("t", 5, 3_000_000_000, "rtt", 1.5, "ms"), ("t", 9, 3_000_000_001, "rtt", 2.5, "ms"), ("u", 1, 1, "rtt", None, "ms")], "tag string, monotonic_ms long, id long, probe string, value double, unit string")
    got = tl.timeline(None, None, rows)
    assert sorted(r.seq for r in got.collect()) == [1, 3_000_000_000, 3_000_000_001]
    assert {r.tag: (r.n_events, r.n_by_source, r.duration_ms) for r in tl.timeline_summary(got).collect()} == {"t": (2, {"kpi": 2}, 4), "u": (1, {"kpi": 1}, 0)}


def test_around_a_hot_tag(spark):
    """1 M events of one tag and 10,000 points: buckets, not one pair for each point and event."""
    events = spark.range(1_000_000).select(F.lit("t").alias("tag"), (F.col("id") * 10).alias("monotonic_ms"))
    points = spark.range(10_000).select(F.lit("t").alias("tag"), (F.col("id") * 1000 + 5).alias("at_ms"))
    got = tl.around(events, points, 20)
    assert got.count() == 4 * 10_000 - 1 and got.where("abs(monotonic_ms - at_ms) > 20").count() == 0
    near = spark.createDataFrame([("t", 0), ("t", -7), ("u", 0), ("t", None)], "tag string, monotonic_ms long")
    at = spark.createDataFrame([("t", -3), ("t", 4), ("t", None)], "tag string, at_ms long")
    assert sorted(map(tuple, tl.around(near, at, 4).select("monotonic_ms", "at_ms").collect())) == [(-7, -3), (0, -3), (0, 4)]


def test_verdicts_are_one_object(spark):
    texts = ['{"root_cause":"a"} and {"root_cause":"b"}', '{"root_cause":"a"}{"root_cause":"b"}', '{"root_cause":"a"},{"root_cause":"b"}', '{"root_cause":"a"}, "w": {"x": 1}', '{"root_cause":"a"}],[{}', "{'root_cause':'a'}", '{"x": 1}', "[1]", "5", "", '{"root_cause": "a"',
             '{"root_cause": null}', ' {"root_cause": "a", "evidence": ["x", 1]} ', 'so {"root_cause": "a"} it is', '```json\n{"root_cause": "a"}\n```', 'x {"y": 1} ```{"root_cause": "a"}``` {']
    got = tr.parse_verdicts(spark.createDataFrame(list(enumerate(texts)), "id long, response string")).orderBy("id").collect()
    assert [r.parsed for r in got] == [False] * 11 + [True] * 5
    assert [r.root_cause for r in got[11:]] == [None, "a", "a", "a", "a"]


def test_triage(spark):
    texts = spark.createDataFrame([(1, "deauth reason=15"), (2, "PMK mismatch"), (3, "DHCPNAK"), (4, "networks=0"), (5, "nonsense")], "id long, text string")
    assert [r.suggested_owner for r in tr.rule_diagnosis(texts).orderBy("id").collect()] == ["wifi_infrastructure", "provisioning", "dhcp", "environment", "unknown"]
    rows = [(1, '{"root_cause": "x", "confidence": "high", "evidence": "one"}'), (2, 'so\n```json\n{"root_cause": "y", "confidence": 0.9, "suggested_owner": "the dhcp team"}\n```'), (3, "none")]
    got = tr.coerce_verdicts(tr.parse_verdicts(spark.createDataFrame(rows, "id long, response string"))).orderBy("id").collect()
    assert [(r.parsed, r.confidence, r.suggested_owner, list(r.evidence)) for r in got] == [(True, 0.0, "unknown", ["one"]), (True, 0.5, "dhcp", []), (False, 0.0, "unknown", [])]
    parts = spark.createDataFrame([("a", n, "x" * 500) for n in ("header", "forensics", "error_window", "templates", "kpi")], "tag string, name string, text string")
    left = tr.trim_to_budget(parts, 300).collect()
    assert {r.name for r in left} == {"header", "forensics"} and all(r.truncated for r in left)
    assert len(tr.trim_to_budget(parts, 500).collect()) == 4


def test_dissections(spark):
    """Hex and plain SSIDs, antennas, hex numbers, texts that are no numbers, what only one says, lost and malformed frames."""
    ours = capture(spark, "c", ["beacon", "auth", "m1", "data"])
    base = {i: {"type_subtype": "", "retry": "", "status_code": "", "reason_code": "", "ssid": "", "rssi": "", "eapol": "3" if i == 2 else "", "malformed": ""} for i in range(4)}
    names = ["type_subtype", "retry", "status_code", "reason_code", "ssid", "rssi", "eapol", "malformed"]

    def run(**changes):
        rows = [("c", i, *({**base[i], **changes.get(f"f{i}", {})}[n] for n in names)) for i in range(4) if changes.get(f"f{i}", {}) is not None]
        theirs = spark.createDataFrame(rows, "capture_id string, frame_index int, " + ", ".join(f"{n} string" for n in names))
        found = sorted((r.frame_index, r.field, r.ours, r.theirs) for r in fr.reconcile_dissections(ours, theirs).collect())
        return found, fr.reconciled_captures(ours, theirs).first()

    first = min(r.frame_index for r in ours.collect())
    assert first == 0
    found, row = run()
    assert found == [] and row.agrees and (row.n_ours, row.n_theirs, list(row.malformed)) == (4, 4, [])
    found, row = run(f0={"type_subtype": "0x08"}, f1={"type_subtype": "11", "status_code": "x", "malformed": "1"}, f2={"eapol": ""}, f3=None)
    assert found == [(2, "is_eapol", "true", "false")] and not row.agrees and (row.n_theirs, list(row.malformed)) == (3, [1])
    found, _ = run(f0={"type_subtype": "0x0005"})
    assert found == [(0, "type_subtype", "8", "5")]


def test_trimmed_sections_lie_in_many_tasks(spark):
    parts = spark.range(2000).select(F.col("id").cast("string").alias("tag"), F.explode(F.array(F.lit("header"), F.lit("kpi"))).alias("name"), F.repeat(F.lit("x"), 900).alias("text"))
    left = tr.trim_to_budget(parts, 300)
    rows = left.select("tag", "name", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == 2000 and {r.name for r in rows} == {"header"}
    assert len({r.p for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_log_text_below_a_folder(spark, tmp_path):
    from wavelake.sources import store

    for name, text in (("tag=a/part=0", "x\ny"), ("tag=b/part=7", "z")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "f.txt").write_text(text)
    got = store.read_log_text(spark, str(tmp_path))
    assert got.columns == ["path", "line_no", "raw"]
    assert sorted((r.line_no, r.raw) for r in got.collect()) == [(1, "x"), (1, "z"), (2, "y")]


def test_tokens_are_cut_once_for_each_message(spark):
    """No mask runs below a grouping of the lines by message, neither in mining nor in matching."""
    said = ["deauth received reason=4", "deauth received reason=4", "deauth received reason=5", "lease 10.0.0.1 of 7", "lease 10.0.0.2 of 8", "", None]
    lines = spark.createDataFrame([("t", i, x) for i, x in enumerate(said)], "tag string, line_no int, message string")
    templates = op.drain_templates(lines)
    matched = op.match_template(lines, templates)
    assert matched.columns == ["tag", "line_no", "message", "template_id"]
    assert [r.template_id for r in matched.orderBy("line_no").collect()] == [1, 1, 1, 2, 2, None, None]
    assert sorted((r.tokens, r.hits, r.examples) for r in templates.collect()) == [(["deauth", "received", "reason=<NUM>"], 3, ["deauth received reason=4"]), (["lease", "<IP>", "of", "<NUM>"], 2, ["lease 10.0.0.1 of 7"])]
    assert_above_grouping(op.distinct_statements(lines, []), "message", "regexp_replace")
    assert_above_grouping(matched, "message", "regexp_replace")


def assert_above_grouping(df, key, what):
    """No expression with `what` is below a grouping by key."""
    depth, grouped = None, 0
    for row in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        at = len(row) - len(row.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if depth is None and f"Aggregate [{key}" in row:
            depth, grouped = at, grouped + 1
        elif depth is not None:
            assert what not in row, row
    assert grouped


def test_ngrams_are_cut_once_for_each_word(spark):
    own = spark.createDataFrame([("a", "Reason4 reason4  lost"), ("b", "reason4"), ("c", ""), ("d", None)], "tag string, signature string")
    got = fa.tfidf_char_ngrams(own)
    assert_above_grouping(got, "word", "substr")
    w = {(r.tag, r.ngram): (r.df, r.weight) for r in got.collect()}
    assert {t for t, _ in w} == {"a", "b"} and w["a", " rea"][0] == 2 and w["a", "lost"][0] == 1
    # twice in a, once there: 1 + ln 2 times its inverse frequency
    assert w["a", " rea"][1] / w["a", "lost"][1] == pytest.approx((1 + math.log(2)) * (math.log(5 / 3) + 1) / (math.log(5 / 2) + 1))


def test_blocks_that_meet_are_not_written_pair_by_pair(spark, monkeypatch):
    """All pairs of like signatures in blocks of three: nothing is dealt after blocks meet."""
    monkeypatch.setattr(fa.cosine, "BLOCK", 3)
    rows = [(f"t{i:02}", f"deauth received reason={i % 7} attempt {i % 5} of many") for i in range(40)]
    t = fa.tfidf_char_ngrams(spark.createDataFrame(rows, "tag string, signature string"))
    got = fa.signature_neighbours(t)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan.split("CartesianProduct")[0]
    vectors = {}
    for r in t.collect():
        vectors.setdefault(r.tag, {})[r.ngram] = r.weight
    want = {}
    for a, x in vectors.items():
        for b, y in vectors.items():
            c = sum(w * y.get(g, 0.0) for g, w in x.items())
            if a < b and c >= 0.65:
                want[a, b] = round(c, 6)
    assert {(r.a, r.b): round(r.cosine, 6) for r in got.collect()} == want and len(want) > 100


def test_a_forest_of_links(spark):
    told = [{"a": pa.array(["b", "c", "z"]), "b": pa.array(["a", "b", "z"])}, {"a": pa.array(["e", "c"]), "b": pa.array(["c", "a"])}, {"a": pa.array(["y"]), "b": pa.array(["x"])}]
    got = fa.cosine.forest(told)
    assert list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == [("b", "a"), ("c", "a"), ("e", "a"), ("y", "x")]


def test_logs_share_files(spark, tmp_path, monkeypatch):
    """Many logs lie in one file, whole or cut, and come back with their own numbers."""
    from wavelake.plans import learning as pl

    monkeypatch.setattr(pl, "place", lambda spark, what: f"{tmp_path}/{what}")
    monkeypatch.setattr(pl, "LINES", 7)
    log = spark.createDataFrame([(None if t == 3 else f"tag {t}", n, f"line {n} of {t}") for t in range(40) for n in range(1, 20 if t % 5 else 40)], "tag string, line_no int, raw string")
    monkeypatch.setattr(pl, "raw", lambda spark, sf: log)
    got = pl.read_log_text(spark, "")
    assert sorted(map(str, got.collect())) == sorted(map(str, log.withColumn("line_no", F.col("line_no").cast("long")).collect()))
    assert len(list((tmp_path / "logs").rglob("*.txt"))) == 1
