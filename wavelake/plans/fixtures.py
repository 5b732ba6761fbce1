"""Tables of this domain derived from the given ones; each statement is plain SQL for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KPI = r"""SELECT event_id AS id, dayofyear(ts) AS run_id, ts,
 concat('net', CAST(user_id % 3 AS STRING)) AS network,
 CASE WHEN user_id % 2 = 0 THEN '5GHz' ELSE '2.4GHz' END AS band,
 concat('ep', CAST(user_id % 5 AS STRING)) AS endpoint_name,
 CASE event_type WHEN 'view' THEN 'icmp_rtt' WHEN 'click' THEN 'dns' WHEN 'purchase' THEN 'throughput' WHEN 'signup' THEN 'jitter' ELSE 'loss' END AS probe,
 CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS value,
 CASE event_type WHEN 'purchase' THEN 'mbps' WHEN 'error' THEN 'pct' ELSE 'ms' END AS unit,
 event_id % 20 <> 0 AS ok
FROM events"""

RESULTS = r"""SELECT o_orderkey AS id, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS run_id,
 concat('tests/', CASE o_custkey % 5 WHEN 0 THEN 'connectivity' WHEN 1 THEN 'interop' WHEN 2 THEN 'performance' WHEN 3 THEN 'pcap' ELSE 'kpi' END, '/test_m.py::t', CAST(o_custkey % 40 AS STRING)) AS nodeid,
 CASE WHEN o_custkey % 40 < 8 THEN 'passed' WHEN o_custkey % 40 < 12 THEN 'failed'
  WHEN o_custkey % 40 < 16 THEN CASE WHEN o_orderdate < TIMESTAMP '1998-05-01' THEN 'failed' ELSE 'passed' END
  WHEN o_custkey % 40 < 20 THEN CASE WHEN o_orderdate < TIMESTAMP '1998-05-01' THEN 'passed' ELSE 'failed' END
  WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'passed'
  WHEN o_orderkey % 7 = 0 THEN 'error' WHEN o_orderkey % 7 = 1 THEN 'skipped' ELSE 'passed' END AS outcome,
 CAST(row_number() OVER (PARTITION BY (year(o_orderdate) - 1995) * 12 + month(o_orderdate), o_custkey % 40 ORDER BY o_orderkey) AS INT) AS attempt,
 o_totalprice / 1000 AS duration_s, o_orderdate AS started_at
FROM orders"""

LOG_RAW = r"""SELECT concat('tag', CAST(user_id AS STRING)) AS tag, event_id,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no,
 CASE WHEN event_id % 17 = 0 THEN '  File "x.py", line 3, in foo'
 ELSE concat('2025-01-01T00:00:00.000Z [', lpad(CAST(event_id AS STRING), 7, ' '), 'ms] <',
  CASE event_type WHEN 'error' THEN 'ERROR ' WHEN 'signup' THEN 'WARN  ' WHEN 'purchase' THEN 'NOTICE' WHEN 'click' THEN 'INFO  ' ELSE 'DEBUG ' END, '> ',
  CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'wifid     ' WHEN 1 THEN 'supplicant' ELSE 'dhcp      ' END, ': ',
  CASE event_type WHEN 'error' THEN concat('deauth received reason=', CAST(event_id % 24 AS STRING))
   WHEN 'signup' THEN concat('retransmitting M2 attempt=', CAST(event_id % 5 AS STRING), ' bssid=02:aa:bb:cc:dd:', lpad(CAST(event_id % 90 AS STRING), 2, '0'))
   WHEN 'purchase' THEN concat('assoc resp status=', CAST(event_id % 3 AS STRING), ' aid=', CAST(user_id AS STRING))
   WHEN 'click' THEN concat('DHCPACK ip=192.168.1.', CAST(event_id % 250 AS STRING), ' lease_s=86400')
   ELSE concat('state transition from=', CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'IDLE' WHEN 1 THEN 'SCANNING' WHEN 2 THEN 'AUTHENTICATING' ELSE 'ASSOCIATING' END, ' event=E', CAST(event_id % 6 AS STRING), ' to=', CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'SCANNING' WHEN 1 THEN 'ASSOCIATING' ELSE 'FAILED' END) END) END AS raw
FROM events"""

FRAMES = r"""WITH e AS (SELECT event_id, user_id, ts, event_id % 23 AS m, CAST(user_id % 8 AS INT) AS v FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e
 WHERE CASE v WHEN 1 THEN m NOT IN (0, 2) WHEN 2 THEN m NOT IN (3, 4) WHEN 3 THEN m <= 4 WHEN 4 THEN m <= 6
  WHEN 5 THEN m <= 12 WHEN 6 THEN m <= 12 WHEN 7 THEN m NOT IN (8, 9) ELSE true END)
SELECT concat('cap', CAST(user_id AS STRING)) AS capture_id, CAST(rn AS INT) AS frame_index, CAST(rn * 130 AS DOUBLE) / 1000 AS time_s,
 CAST(CASE WHEN m <= 9 THEN 0 WHEN m = 10 THEN 1 ELSE 2 END AS INT) AS ftype,
 CAST(CASE m WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 11 WHEN 4 THEN 11 WHEN 5 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 12 WHEN 9 THEN 10 WHEN 10 THEN 13 WHEN 11 THEN 0 WHEN 12 THEN 0 WHEN 13 THEN 0 WHEN 14 THEN 0 ELSE 8 END AS INT) AS subtype,
 concat('02:aa:bb:cc:dd:0', CAST(event_id % 3 AS STRING)) AS addr1, concat('02:11:22:33:44:0', CAST(user_id % 9 AS STRING)) AS addr2, concat('02:aa:bb:cc:dd:0', CAST(event_id % 3 AS STRING)) AS addr3,
 event_id % 6 = 0 AS retry, event_id % 4 = 0 AS protected, event_id % 29 = 0 AS bad_fcs,
 CAST(-40 - event_id % 55 AS INT) AS rssi_dbm,
 CASE WHEN m = 0 THEN concat('ssid', CAST(user_id % 7 AS STRING)) END AS ssid,
 CAST(CASE WHEN m IN (3, 4) THEN CASE WHEN event_id % 5 = 0 THEN 16 ELSE 0 END WHEN m = 6 THEN CASE WHEN v = 4 OR event_id % 3 = 0 THEN 17 ELSE 0 END END AS INT) AS status_code,
 CAST(CASE WHEN m IN (8, 9) THEN CASE WHEN v = 5 THEN 15 WHEN v = 6 THEN 23 ELSE CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 3 WHEN 1 THEN 8 WHEN 2 THEN 15 WHEN 3 THEN 23 ELSE 34 END END END AS INT) AS reason_code,
 CAST(CASE WHEN m = 3 THEN 0 WHEN m = 4 THEN 3 END AS INT) AS auth_algo, CAST(CASE WHEN m IN (3, 4) THEN 1 + event_id % 2 END AS INT) AS auth_seq,
 CAST(CASE m WHEN 11 THEN 138 WHEN 12 THEN 266 WHEN 13 THEN 5066 WHEN 14 THEN 778 END AS INT) AS key_info,
 CASE WHEN m IN (11, 12, 13, 14) THEN rn END AS replay_counter,
 CASE WHEN m = 0 THEN CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'PSK' WHEN 1 THEN 'SAE' ELSE NULL END END AS rsn_akm
FROM k"""

#: A failure for each customer: ten kinds of bug, each in many wordings, and some that are like no other.
FAILED = r"""SELECT concat('run', CAST(c_custkey AS STRING)) AS tag, CASE WHEN c_custkey % 11 = 10 THEN NULL ELSE concat('bug', CAST(c_custkey % 11 AS STRING)) END AS fault,
 CASE CAST(c_custkey % 11 AS INT)
  WHEN 10 THEN md5(CAST(c_custkey AS STRING))
  ELSE concat(CASE CAST(c_custkey % 11 AS INT)
   WHEN 0 THEN '4-way handshake timed out waiting for M3 final_state:IDLE path:ASSOCIATING>KEYING stage:associated handshake incomplete m2 retransmitted missing_m3'
   WHEN 1 THEN 'PMK mismatch MIC failure in M2 wrong passphrase reason=23 final_state:FAILED stage:associated credentials rejected by authenticator missing_m3'
   WHEN 2 THEN 'DHCPNAK received no lease offered address request declined by server final_state:CONFIGURING stage:data connected and passed data'
   WHEN 3 THEN 'scan complete networks=0 access point never heard on any channel final_state:SCANNING stage:none the AP was never heard'
   WHEN 4 THEN 'beacon lost rssi collapsed while roaming away deauthenticated reason=34 final_state:IDLE stage:keyed degraded_rssi_collapse degraded_weak_signal'
   WHEN 5 THEN 'authentication rejected status=13 unsupported algorithm SAE required by network final_state:AUTHENTICATING stage:scanned authentication rejected'
   WHEN 6 THEN 'association denied status=17 too many stations already joined this cell final_state:ASSOCIATING stage:authenticated association rejected'
   WHEN 7 THEN 'medium busy airtime exhausted retries climbing frames dropped transmit queue stalled final_state:CONNECTED stage:data degraded_high_retry'
   WHEN 8 THEN 'DNS lookup servfail resolver unreachable name not found upstream outage final_state:CONNECTED stage:data connected, no data seen'
   ELSE 'firmware assertion watchdog fired chip reset driver reloading interface down unexpectedly final_state:RESET stage:keyed connected, then lost' END,
   ' attempt ', CAST(c_custkey % 5 AS STRING), ' of ', lower(c_mktsegment), ' fleet') END AS signature
FROM customer"""

BASE = {"failed": (FAILED, "customer"), "kpi": (KPI, "events"), "results": (RESULTS, "orders"), "log_raw": (LOG_RAW, "events"), "frames": (FRAMES, "events")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table (see BASE), or a given one."""
    if name not in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, given = BASE[name]
    out = spark.sql(sql.replace(f"FROM {given}", "FROM {given}"), given=spark.read.parquet(f"{sf_dir}/{given}.parquet"))
    return out.withColumn("run_id", out.run_id.cast("long")) if "run_id" in out.columns else out


def ctes(*names: str) -> str:
    """WITH clause of derived tables, open for more."""
    return "WITH " + ", ".join(f"{n} AS ({BASE[n][0]})" for n in names)
