"""Queries over log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs as f
from ..operators import logs as op
from ..session import written
from .fixtures import ctes, table
from .registry import query

LOG = ctes("log_raw")
SIM = f.SIM_LINE.replace("'", "''")
PARSED = f"""{LOG}, p AS (SELECT *, regexp_matches(raw, '{SIM}') AS is_sim, regexp_extract(raw, '{SIM}', 2) AS ms_text FROM log_raw WHERE trim(raw) <> ''),
q AS (SELECT tag, event_id, line_no, raw, is_sim, coalesce(last_value(CASE WHEN is_sim THEN CAST(ms_text AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY tag ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS monotonic_ms,
 CASE WHEN is_sim THEN regexp_extract(raw, '{SIM}', 3) ELSE 'INFO' END AS level, CASE WHEN is_sim THEN regexp_extract(raw, '{SIM}', 4) ELSE 'unparsed' END AS component, CASE WHEN is_sim THEN regexp_extract(raw, '{SIM}', 5) ELSE trim(raw) END AS message FROM p)"""
# values of a key=value field, the last one of a key
FIELD = lambda key: f"list_last(regexp_extract_all(message, '\\b{key}=(\\S+)', 1))"
FIELDS = f"{PARSED}, l AS (SELECT *, {FIELD('reason')} AS reason, {FIELD('status')} AS status, {FIELD('from')} AS f_from, {FIELD('event')} AS f_event, {FIELD('to')} AS f_to FROM q)"


def raw(spark, sf):
    return table(spark, sf, "log_raw")


def lines(spark, sf):
    return op.parse_mixed_log(raw(spark, sf))


@query("parse_sim_log", f"{PARSED} SELECT event_id, CASE WHEN is_sim THEN regexp_extract(raw, '{SIM}', 1) END AS ts, CASE WHEN is_sim THEN CAST(ms_text AS BIGINT) END AS mono_ms, CASE WHEN is_sim THEN level END AS level, CASE WHEN is_sim THEN component END AS component, CASE WHEN is_sim THEN message END AS message FROM q JOIN p USING (tag, event_id, line_no, raw, is_sim)")
def parse_sim_log(spark, sf):
    return op.parse_sim_log(raw(spark, sf)).select("event_id", "ts", "mono_ms", "level", "component", "message")


UNI = f.UNIFIED_LINE.replace("'", "''")
UNIFIED = "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'no such line' ELSE concat('2026-09-25 14:32:', lpad(CAST(event_id % 60 AS STRING), 2, '0'), '.', lpad(CAST(event_id % 1000 AS STRING), 3, '0'), ' ', CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'Df' WHEN 1 THEN 'I' WHEN 2 THEN 'Nt' WHEN 3 THEN 'Er' WHEN 4 THEN 'Wn' WHEN 5 THEN 'Ft' ELSE 'Xx' END, ' wifid[123:456] [com.apple.wifi:Client] scan complete networks=', CAST(event_id % 9 AS STRING)) END AS raw FROM events"


@query("parse_unified_log", f"WITH u AS ({UNIFIED}), p AS (SELECT *, regexp_matches(raw, '{UNI}') AS ok FROM u) SELECT event_id, CASE WHEN ok THEN regexp_extract(raw, '{UNI}', 1) END AS ts, CASE WHEN ok THEN CASE regexp_extract(raw, '{UNI}', 2) WHEN 'Df' THEN 'DEBUG' WHEN 'I' THEN 'INFO' WHEN 'Nt' THEN 'NOTICE' WHEN 'Er' THEN 'ERROR' WHEN 'Wn' THEN 'WARN' WHEN 'Ft' THEN 'ERROR' WHEN '<Notice>' THEN 'NOTICE' ELSE 'INFO' END END AS level, CASE WHEN ok THEN regexp_extract(raw, '{UNI}', 3) END AS component, CASE WHEN ok THEN regexp_extract(raw, '{UNI}', 5) END AS message FROM p")
def parse_unified_log(spark, sf):
    u = spark.sql(UNIFIED.replace("FROM events", "FROM {e}"), e=table(spark, sf, "events"))
    return op.parse_unified_log(u).select("event_id", "ts", "level", "component", "message")


@query("parse_mixed_log", f"{PARSED} SELECT tag, line_no, monotonic_ms, level, component, message FROM q")
def parse_mixed_log(spark, sf):
    return lines(spark, sf).select("tag", "line_no", "monotonic_ms", "level", "component", "message")


@query("extract_fields", f"{FIELDS} SELECT event_id, reason, status, f_to AS to_state, {FIELD('bssid')} AS bssid FROM l")
def extract_fields(spark, sf):
    get = lambda k: F.element_at("fields", k)
    return lines(spark, sf).select("event_id", get("reason").alias("reason"), get("status").alias("status"), get("to").alias("to_state"), get("bssid").alias("bssid"))


@query("get_int_field", f"{FIELDS} SELECT event_id, coalesce(TRY_CAST(reason AS INT), -1) AS reason FROM l")
def get_int_field(spark, sf):
    return lines(spark, sf).select("event_id", f.int_field(F.col("fields"), "reason", -1).alias("reason"))


@query("flag_error_lines", f"{PARSED} SELECT event_id, level IN ('ERROR', 'WARN') AS is_error FROM q")
def flag_error_lines(spark, sf):
    return op.flag_error_lines(lines(spark, sf)).select("event_id", "is_error")


def masked(x):
    for p, r in f.MASKS:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


@query("mask_log_message", f"{PARSED} SELECT event_id, {masked('message')} AS masked FROM q")
def mask_log_message(spark, sf):
    return lines(spark, sf).select("event_id", f.mask(F.col("message")).alias("masked"))


@query("tokenise_message", f"{PARSED} SELECT event_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens FROM (SELECT event_id, list_filter(regexp_split_to_array({masked('message')}, '\\s+'), lambda x: x <> '') AS t FROM q)")
def tokenise_message(spark, sf):
    t = f.tokens(F.col("message"))
    return lines(spark, sf).select("event_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, "|").alias("tokens"))


def scrubbed(x):
    for p in f.VOLATILE:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("scrub_signature", f"{PARSED} SELECT event_id, {scrubbed('message')} AS signature FROM q")
def scrub_signature(spark, sf):
    return lines(spark, sf).select("event_id", f.scrub(F.col("message")).alias("signature"))


@query("search_logs", f"{PARSED} SELECT tag, line_no, message FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY line_no) AS rank FROM q WHERE contains(lower(message), 'reason=1') AND level = 'ERROR') WHERE rank <= 3")
def search_logs(spark, sf):
    return op.search_logs(lines(spark, sf), "Reason=1", "error", 3).select("tag", "line_no", "message")


TRANSITIONS = f"{FIELDS}, tr AS (SELECT * FROM l WHERE contains(message, 'state transition') AND f_from IS NOT NULL AND f_to IS NOT NULL)"
PATH = "SELECT tag, count(*) AS n_transitions, array_to_string((list(f_to ORDER BY line_no))[-6:], '>') AS path, arg_max(f_to, line_no) AS final_state FROM tr GROUP BY tag"


@query("state_path", f"{TRANSITIONS} {PATH}")
def state_path(spark, sf):
    return op.state_path(lines(spark, sf))


#: Legal state changes (state, event, next state), with the events of the derived logs.
LEGAL = [("IDLE", "E0", "SCANNING"), ("SCANNING", "E1", "ASSOCIATING"), ("SCANNING", "E2", "FAILED"), ("AUTHENTICATING", "E1", "ASSOCIATING"), ("AUTHENTICATING", "E4", "ASSOCIATING"), ("AUTHENTICATING", "E2", "FAILED"), ("ASSOCIATING", "E5", "FAILED"), ("ASSOCIATING", "E3", "SCANNING")]


@query("illegal_transitions", f"{TRANSITIONS}, b AS (SELECT *, coalesce(lag(f_to) OVER (PARTITION BY tag ORDER BY line_no) <> f_from, false) AS broken FROM tr) SELECT tag, line_no, f_from AS from_state, f_event AS event, f_to AS to_state, broken FROM b WHERE (f_from, f_event, f_to) NOT IN ({', '.join(map(str, LEGAL))})")
def illegal_transitions(spark, sf):
    legal = spark.createDataFrame(LEGAL, "`from` string, event string, `to` string")
    return op.illegal_transitions(lines(spark, sf), legal).select("tag", "line_no", F.col("from").alias("from_state"), "event", F.col("to").alias("to_state"), "broken")


@query("log_summary", f"""{TRANSITIONS}, path AS ({PATH}), s AS (SELECT tag, count(*) AS total, count(*) FILTER (level = 'ERROR') AS n_errors, count(*) FILTER (level = 'WARN') AS n_warnings, arg_max(monotonic_ms, line_no) - arg_min(monotonic_ms, line_no) AS duration_ms,
coalesce(array_to_string(list(TRY_CAST(reason AS INT) ORDER BY line_no) FILTER (TRY_CAST(reason AS INT) IS NOT NULL), ','), '') AS reason_codes, coalesce(array_to_string(list(TRY_CAST(status AS INT) ORDER BY line_no) FILTER (TRY_CAST(status AS INT) <> 0), ','), '') AS status_codes, count(DISTINCT level) AS n_levels, count(*) FILTER (component = 'dhcp') AS n_dhcp FROM l GROUP BY tag)
SELECT s.*, coalesce(n_transitions, 0) AS n_transitions, path, final_state FROM s LEFT JOIN path USING (tag)""")
def log_summary(spark, sf):
    s = op.log_summary(lines(spark, sf))
    return s.select("tag", "total", "n_errors", "n_warnings", "duration_ms", F.array_join("reason_codes", ",").alias("reason_codes"), F.array_join("status_codes", ",").alias("status_codes"), F.size("by_level").cast("long").alias("n_levels"), F.coalesce(F.element_at("by_component", "dhcp"), F.lit(0)).alias("n_dhcp"), "n_transitions", "path", "final_state")


# templates, as a fold over the distinct statements of each leaf in order of their first line; no length has over 100 first tokens here, so a leaf's keys are its tokens
KEY = lambda i: f"CASE WHEN regexp_matches(coalesce(tokens[{i}], ''), '^<.*>$') THEN '<*>' ELSE coalesce(tokens[{i}], '') END"
LIKE = lambda template, tokens: f"len(list_filter(range(1, len({template}) + 1), lambda k: {template}[k] = {tokens}[k] OR {template}[k] = '<*>'))"
TEMPLATES = f"""WITH RECURSIVE{PARSED.removeprefix('WITH')}, tok AS (SELECT tag, line_no, message, list_filter(regexp_split_to_array({masked('message')}, '\\s+'), lambda x: x <> '') AS tokens FROM q),
st AS (SELECT tokens, count(*) AS n, min(struct_pack(tag := tag, line_no := line_no)) AS first, arg_min(message, struct_pack(tag := tag, line_no := line_no)) AS example FROM tok WHERE len(tokens) > 0 GROUP BY tokens),
leaves AS (SELECT *, len(tokens) AS width, {KEY(1)} AS key1, {KEY(2)} AS key2 FROM st), placed AS (SELECT *, row_number() OVER (PARTITION BY width, key1, key2 ORDER BY first) AS i FROM leaves),
fold AS (SELECT width, key1, key2, i, [tokens] AS found, [n] AS hits, [first] AS firsts, [[example]] AS examples FROM placed WHERE i = 1
 UNION ALL SELECT width, key1, key2, i,
  CASE WHEN fits THEN list_transform(found, lambda t, j: CASE WHEN j = best THEN list_transform(t, lambda x, k: CASE WHEN x = tokens[k] THEN x ELSE '<*>' END) ELSE t END) ELSE list_append(found, tokens) END,
  CASE WHEN fits THEN list_transform(hits, lambda x, j: CASE WHEN j = best THEN x + n ELSE x END) ELSE list_append(hits, n) END,
  CASE WHEN fits THEN firsts ELSE list_append(firsts, first) END,
  CASE WHEN fits THEN list_transform(examples, lambda x, j: CASE WHEN j = best AND len(x) < 3 THEN list_append(x, example) ELSE x END) ELSE list_append(examples, [example]) END
 FROM (SELECT *, list_position(scores, list_max(scores)) AS best, list_max(scores) >= 0.5 * width AS fits
  FROM (SELECT p.*, found, hits, firsts, examples, list_transform(found, lambda t: {LIKE('t', 'p.tokens')}) AS scores FROM fold o JOIN placed p ON p.width = o.width AND p.key1 = o.key1 AND p.key2 = o.key2 AND p.i = o.i + 1))),
mined AS (SELECT width, key1, key2, unnest(found) AS pattern, unnest(hits) AS hits, unnest(firsts) AS first, unnest(examples) AS examples FROM fold QUALIFY row_number() OVER (PARTITION BY width, key1, key2 ORDER BY i DESC) = 1),
templates AS (SELECT *, row_number() OVER (ORDER BY first) AS template_id FROM mined)"""
MATCHED = f"""{TEMPLATES}, best AS (SELECT tokens, arg_min(template_id, struct_pack(miss := width - score, id := template_id)) AS template_id
 FROM (SELECT l.tokens, template_id, l.width, {LIKE('pattern', 'l.tokens')} AS score FROM leaves l JOIN templates t ON l.width = t.width AND t.key1 IN (l.key1, '<*>') AND t.key2 IN (l.key2, '<*>')) WHERE score >= 0.5 * width GROUP BY tokens),
matched AS (SELECT tag, line_no, template_id FROM tok LEFT JOIN best USING (tokens))"""


@query("drain_templates", f"{TEMPLATES} SELECT template_id, array_to_string(pattern, ' ') AS text, hits, array_to_string(examples, ' | ') AS examples FROM templates")
def drain_templates(spark, sf):
    return op.drain_templates(lines(spark, sf)).select("template_id", F.array_join("tokens", " ").alias("text"), "hits", F.array_join("examples", " | ").alias("examples"))


@query("match_template", f"{MATCHED} SELECT tag, line_no, template_id FROM matched")
def match_template(spark, sf):
    l = lines(spark, sf)
    return op.match_template(l, op.drain_templates(l)).select("tag", "line_no", "template_id")


@query("top_templates", f"{TEMPLATES} SELECT CAST(row_number() OVER (ORDER BY hits DESC, template_id) AS INT) AS rank, template_id, hits, array_to_string(pattern, ' ') AS text FROM templates ORDER BY hits DESC, template_id LIMIT 25")
def top_templates(spark, sf):
    return op.top_templates(op.drain_templates(lines(spark, sf))).select("rank", "template_id", "hits", F.array_join("tokens", " ").alias("text"))


@query("compression_ratio", f"{TEMPLATES} SELECT (SELECT count(*) FROM q) AS lines, (SELECT count(*) FROM templates) AS templates, 1 - (SELECT count(*) FROM templates) / (SELECT count(*) FROM q) AS ratio")
def compression_ratio(spark, sf):
    l = lines(spark, sf)
    return op.compression_ratio(l, op.drain_templates(l))


@query("template_histogram", f"""{MATCHED} SELECT tag, '{{' || string_agg('"' || template_id || '":' || n, ',' ORDER BY template_id) || '}}' AS histogram FROM (SELECT tag, template_id, count(*) AS n FROM matched WHERE template_id IS NOT NULL GROUP BY tag, template_id) GROUP BY tag""")
def template_histogram(spark, sf):
    l = written(lines(spark, sf).select("line_no", "tag", "message"), "lines")
    return op.template_histogram(op.match_template(l, op.drain_templates(l))).select("tag", F.to_json("histogram").alias("histogram"))
