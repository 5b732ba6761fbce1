"""Log lines: parsing by file, summaries, templates and their counts.

Lines of one log (tag) are ordered by line_no.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import logs as f
from ..session import numbered, ship, written

WILD = "<*>"


def parse_sim_log(raw: DataFrame) -> DataFrame:
    """ts, mono_ms, level, component, message of fixed-width lines; null where the line has another format."""
    c = F.col("raw")
    return raw.withColumns({"ts": f.sim_part(c, 1), "mono_ms": f.sim_part(c, 2).cast("long"), "level": f.sim_part(c, 3), "component": f.sim_part(c, 4), "message": f.sim_part(c, 5)})


def parse_unified_log(raw: DataFrame) -> DataFrame:
    """The same of the operating system's lines; the level is that of its flag."""
    c = F.col("raw")
    name = F.coalesce(F.nullif(f.unified_part(c, 3), F.lit("")), F.nullif(f.unified_part(c, 4), F.lit("")), F.lit("unknown"))
    return raw.withColumns({"ts": f.unified_part(c, 1), "level": F.when(c.rlike(f.UNIFIED_LINE), f.flag_level(f.unified_part(c, 2))), "component": F.when(c.rlike(f.UNIFIED_LINE), name), "message": f.unified_part(c, 5)})


def parse_mixed_log(raw: DataFrame) -> DataFrame:
    """Lines of any format, blank ones left out. The clock of unified lines starts at the log's first; a line of no known format has the clock of the line before it."""
    own = raw.where(F.trim("raw") != "")
    sim = parse_sim_log(own).withColumnsRenamed({c: f"s_{c}" for c in ("ts", "mono_ms", "level", "component", "message")})
    both = parse_unified_log(sim)
    is_sim, is_unified = F.col("s_ts").isNotNull(), F.col("s_ts").isNull() & F.col("ts").isNotNull()
    w = W.partitionBy("tag").orderBy("line_no")
    every = W.partitionBy("tag").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = F.when(is_unified, F.col("ts").try_cast("timestamp"))
    both = both.withColumn("_at", at)
    both = both.withColumn("_epoch", F.first("_at", ignorenulls=True).over(every))
    elapsed = F.greatest(F.lit(0), F.unix_millis("_at") - F.unix_millis("_epoch"))
    both = both.withColumn("_ms", F.when(is_sim, F.col("s_mono_ms")).when(is_unified, F.coalesce(elapsed, F.lit(0))))
    pick = lambda c, other: F.when(is_sim, F.col(f"s_{c}")).when(is_unified, F.col(c)).otherwise(other)
    out = both.select(
        *raw.columns,
        F.coalesce(F.last("_ms", ignorenulls=True).over(w), F.lit(0)).alias("monotonic_ms"),
        pick("level", F.lit("INFO")).alias("level"),
        pick("component", F.lit("unparsed")).alias("component"),
        pick("message", F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("message"),
        F.when(is_sim, "sim").when(is_unified, "unified").otherwise("unparsed").alias("source"),
    )
    return out.withColumn("fields", f.extract_fields(F.col("message")))


def flag_error_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("is_error", F.col("level").isin(*f.ERRORS))


def search_logs(lines: DataFrame, text: str, level: str | None = None, limit: int = 40) -> DataFrame:
    """The first lines of each tag that contain text, in any case, and have the level."""
    own = lines.where(F.lower("message").contains(text.lower()))
    if level:
        own = own.where(F.col("level") == level.upper())
    return own.withColumn("rank", F.row_number().over(W.partitionBy("tag").orderBy("line_no"))).where(F.col("rank") <= limit)


def transitions(lines: DataFrame) -> DataFrame:
    """tag, line_no, monotonic_ms, from, event, to of state transitions."""
    get = lambda k: F.element_at("fields", k)
    return lines.where(F.col("message").contains("state transition")).select("tag", "line_no", "monotonic_ms", get("from").alias("from"), get("event").alias("event"), get("to").alias("to")).where("`from` is not null and `to` is not null")


def _is_transition() -> Column:
    return F.col("message").contains("state transition") & F.element_at("fields", "from").isNotNull() & F.element_at("fields", "to").isNotNull()


def state_path(lines: DataFrame) -> DataFrame:
    """The last six states of each tag, and the final one. No more than six of a tag's transitions are gathered."""
    out = _with_rank(lines).groupBy("tag").agg(F.count_if("_is").alias("n_transitions"), _last_states().alias("states")).where("n_transitions > 0")
    return out.select("tag", "n_transitions", F.array_join("states", ">").alias("path"), F.element_at("states", -1).alias("final_state"))


def _with_rank(lines: DataFrame) -> DataFrame:
    """lines with _is (a transition) and _rank: 1 for the last transition of a tag, 2 for the one before."""
    rows = lines.withColumn("_is", F.coalesce(_is_transition(), F.lit(False)))
    return rows.withColumn("_rank", F.count_if("_is").over(W.partitionBy("tag").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, 0)))


def _last_states() -> Column:
    own = F.when(F.col("_is") & (F.col("_rank") <= 6), F.struct("line_no", F.element_at("fields", "to").alias("to")))
    return F.transform(F.array_sort(F.collect_list(own)), lambda x: x["to"])


def illegal_transitions(lines: DataFrame, legal: DataFrame) -> DataFrame:
    """Transitions that the table (from, event, to) hasn't, and whether the line before ended in another state."""
    w = W.partitionBy("tag").orderBy("line_no")
    seen = transitions(lines).withColumn("broken", F.coalesce(F.lag("to").over(w) != F.col("from"), F.lit(False)))
    return seen.join(legal, ["from", "event", "to"], "left_anti")


def log_summary(lines: DataFrame) -> DataFrame:
    """One row for each tag: totals, errors, duration, levels and components, codes, path. Lines are counted once by (tag, level, component) and these cells rolled up; lines that come from parse_mixed_log lie by tag already, so nothing is shuffled again."""
    c = F.col
    r, s = f.int_field(c("fields"), "reason"), f.int_field(c("fields"), "status")
    coded = lambda x, ok: F.collect_list(F.when(ok, F.struct("line_no", x.alias("x"))))
    rows = _with_rank(lines).withColumns({"_r": r, "_s": s})
    own = F.when(c("_is") & (c("_rank") <= 6), F.struct("line_no", F.element_at("fields", "to").alias("x")))
    cells = rows.groupBy("tag", "level", "component").agg(
        F.count("*").alias("n"), F.min(F.struct("line_no", "monotonic_ms")).alias("first"), F.max(F.struct("line_no", "monotonic_ms")).alias("last"),
        coded(c("_r"), c("_r").isNotNull()).alias("reasons"), coded(c("_s"), c("_s") != 0).alias("statuses"), F.count_if("_is").alias("moves"), F.collect_list(own).alias("states"),
    )
    flat = lambda x: F.transform(F.array_sort(F.flatten(F.collect_list(x))), lambda y: y["x"])
    out = cells.groupBy("tag").agg(
        F.sum("n").alias("total"), F.sum(F.when(c("level") == "ERROR", c("n")).otherwise(0)).alias("n_errors"), F.sum(F.when(c("level") == "WARN", c("n")).otherwise(0)).alias("n_warnings"),
        (F.max("last")["monotonic_ms"] - F.min("first")["monotonic_ms"]).alias("duration_ms"), flat("reasons").alias("reason_codes"), flat("statuses").alias("status_codes"),
        F.collect_list(F.struct("level", "component", "n")).alias("cells"), F.sum("moves").alias("n_transitions"), flat("states").alias("states"),
    )

    def by(name: str) -> Column:
        total = lambda x: F.aggregate(F.filter("cells", lambda y: y[name] == x), F.lit(0).cast("long"), lambda n, y: n + y["n"])
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform("cells", lambda y: y[name]))), lambda x: F.struct(x.alias(name), total(x).alias("n"))))

    return out.withColumns({"by_level": by("level"), "by_component": by("component"), "path": F.nullif(F.array_join("states", ">"), F.lit("")), "final_state": F.try_element_at("states", F.lit(-1))}).drop("cells", "states")


def _tokens_of_group() -> Column:
    """Tokens of a group's message. They hang on the number n of its lines, as filters of them would be computed for each line otherwise: Spark moves those that ask for the message alone below the grouping."""
    return F.when(F.col("n") > 0, f.tokens(F.col("message")))


def distinct_statements(lines: DataFrame, scope: list[str]) -> DataFrame:
    """The distinct token lists of each scope with their number, their first place, and a message of it. Messages are cut into tokens once for all lines that say the same."""
    said = lines.groupBy(*scope, "message").agg(F.count("*").alias("n"), F.min(F.struct("tag", "line_no")).alias("first"))
    rows = said.withColumn("tokens", _tokens_of_group())
    out = rows.groupBy(*scope, "tokens").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min_by("message", "first").alias("example"))
    return out.where(F.size("tokens") > 0)


#: Statements or templates of a leaf that one task mines at first.
CHUNK = 2000


def _mined(group: pd.DataFrame, keys: list[str], threshold: float) -> pd.DataFrame:
    """Templates of one leaf's statements (tokens, hits, first, examples) in order of first: each joins the template that it is most like, the earliest among equals, or is a new one. What a template and a statement differ in becomes a wildcard. Templates can be mined like statements: a wildcard is like a wildcard alone."""
    group = group.assign(_t=[x["tag"] for x in group["first"]], _l=[x["line_no"] for x in group["first"]]).sort_values(["_t", "_l"], kind="stable")
    width = len(group["tokens"].iloc[0])
    names, codes = {WILD: 0}, np.empty((len(group), width), np.int32)
    for i, tokens in enumerate(group["tokens"]):
        codes[i] = [names.setdefault(t, len(names)) for t in tokens]
    found, members, n = np.empty((16, width), np.int32), [], 0
    for i in range(len(codes)):
        own = codes[i]
        like = ((found[:n] == own) | (found[:n] == 0)).sum(1)
        j = int(like.argmax()) if n else 0
        if n and like[j] / width >= threshold:
            found[j][found[j] != own] = 0
            members[j].append(i)
        else:
            if n == len(found):
                found = np.concatenate([found, np.empty_like(found)])
            found[n] = own
            members.append([i])
            n += 1
    word, hits, examples = list(names), group["hits"].to_numpy(), group["examples"].tolist()
    first = group["first"].tolist()
    out = pd.DataFrame({"tokens": [[word[c] for c in row] for row in found[:n]], "hits": [int(hits[m].sum()) for m in members], "first": [first[m[0]] for m in members], "examples": [[x for i in m[:3] for x in examples[i]][:3] for m in members]})
    for k in keys:
        out[k] = group[k].iloc[0]
    return out[[*keys, "tokens", "hits", "first", "examples"]]


def drain_templates(lines: DataFrame, scope: list[str] | None = None, threshold: float = 0.5, max_children: int = 100, chunk: int = CHUNK) -> DataFrame:
    """template_id, tokens, hits, examples of each scope (all lines by default).

    Repeats of a statement never change a template, so distinct ones are mined, in order of
    their first line. A statement belongs to a leaf by its number of tokens and its first two
    tokens; a token of signs, or one that comes after max_children others, goes to a shared
    branch. Leaves are independent. A leaf of more than `chunk` statements is cut into chunks in this order, which are
    mined by tasks of their own; their templates, in order, are then mined like statements, in chunks of twice the size, until a leaf
    is one chunk. The result is that of one pass where
    kinds of statements are apart. Where they run into each other it can differ: on made-up streams of one vocabulary under 2 % of the lines were
    in other templates, and up to 16 % where half-wild templates take in whole kinds, in an order that chunks change. Hits are those of the statements that a template has taken in.
    """
    scope = scope or []
    spark = lines.sparkSession
    ship(spark)
    # written, as each level of keys reads it twice
    rows = written(distinct_statements(lines, scope).withColumn("length", F.size("tokens")), "distinct")
    parent, keys = [*scope, "length"], []
    for i, key in ((0, "key1"), (1, "key2")):
        token = F.coalesce(F.get("tokens", F.lit(i)), F.lit(""))
        own = F.when(token.rlike(r"^<.*>$"), WILD).otherwise(token)
        rows = rows.withColumn("_own", own)
        seen = rows.groupBy(*parent, *keys, "_own").agg(F.min("first").alias("_seen"))
        rank = F.row_number().over(W.partitionBy(*parent, *keys).orderBy(F.col("_own") == WILD, "_seen"))
        seen = seen.withColumn(key, F.when((F.col("_own") == WILD) | (rank > max_children), WILD).otherwise(F.col("_own"))).drop("_seen")
        rows = rows.join(seen, [*parent, *keys, "_own"]).drop("_own")
        keys.append(key)
    leaf, kinds = [*scope, "length", "key1", "key2"], dict(lines.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in scope), "length int, key1 string, key2 string, tokens array<string>, hits long", f"first struct<tag:{kinds['tag']},line_no:{kinds['line_no']}>", "examples array<string>"])
    rows = written(rows.select(*leaf, "tokens", F.col("n").alias("hits"), "first", F.array("example").alias("examples")), "statements")
    mine = lambda group: _mined(group, leaf, threshold)
    while (rows.groupBy(*leaf).count().agg(F.max("count")).first()[0] or 0) > chunk:
        # places are in order of leaf and first line, so a leaf's chunks are in its order
        placed = numbered(rows.withColumn("_order", F.struct(*leaf, "first")), "_order", "place")
        rows = written(placed.groupBy(*leaf, F.floor(F.col("place") / chunk).alias("_chunk")).applyInPandas(mine, schema), "templates")
        chunk *= 2
    out = rows.groupBy(*leaf).applyInPandas(mine, schema)
    if scope:
        return out.withColumn("template_id", F.row_number().over(W.partitionBy(*scope).orderBy("first")).cast("long"))
    return numbered(out, "first", "template_id").withColumn("template_id", F.col("template_id").cast("long") + 1)


def match_template(lines: DataFrame, templates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """lines with the best template of their length (the earliest among equals), or none. Distinct messages are cut into tokens and distinct statements matched, not lines."""
    rows = lines.groupBy("message").agg(F.count("*").alias("n")).withColumn("tokens", _tokens_of_group()).withColumn("length", F.size("tokens"))
    known = templates.select("template_id", F.col("tokens").alias("pattern"), "length", "key1", "key2")
    # a statement goes to the leaves of its own first tokens and to the shared ones
    one = lambda i: F.array_distinct(F.array(F.coalesce(F.get("tokens", F.lit(i)), F.lit("")), F.lit(WILD)))
    own = rows.select("tokens", "length").distinct().withColumn("key1", F.explode(one(0))).withColumn("key2", F.explode(one(1)))
    pairs = own.join(known, ["length", "key1", "key2"])
    score = F.aggregate(F.zip_with("tokens", "pattern", lambda a, b: ((a == b) | (b == WILD)).cast("int")), F.lit(0), lambda n, x: n + x) / F.col("length")
    best = pairs.withColumn("score", score).where(F.col("score") >= threshold).groupBy("tokens").agg(F.max_by("template_id", F.struct("score", -F.col("template_id"))).alias("template_id"))
    return lines.join(rows.select("message", "tokens").join(best, "tokens").select("message", "template_id"), "message", "left").select(*lines.columns, "template_id")


def top_templates(templates: DataFrame, k: int = 25) -> DataFrame:
    first = templates.orderBy(F.desc("hits"), "template_id").limit(k)  # only these are ranked in one task
    return first.withColumn("rank", F.row_number().over(W.orderBy(F.desc("hits"), "template_id")))


def compression_ratio(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """1 - templates / lines."""
    return lines.agg(F.count("*").alias("lines")).crossJoin(templates.agg(F.count("*").alias("templates"))).withColumn("ratio", 1 - F.col("templates") / F.col("lines"))


def template_histogram(matched: DataFrame) -> DataFrame:
    """tag and its template ids with the number of lines of each."""
    each = matched.where("template_id is not null").groupBy("tag", "template_id").agg(F.count("*").alias("n"))
    return each.groupBy("tag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("template_id", "n")))).alias("histogram"))
