"""Conversation structure repair: the cheapest edits after which roles alternate, by an auction for shortest paths.

Rows are ordered by turn (nulls first), then role, then the SHA-256 of the text. A row's first fault counts: blank (no character but white
space), duplicate (role and text seen earlier in the conversation), truncated (its last such character is none of .!?). Edits: keep
a row (0), give it the role user or assistant (3), delete it (4; the only choice for blank and duplicate rows), insert an
empty user or assistant row anywhere (3); a truncated row that stays adds 3. The initials of the roles must then read
(s?(ua)+)?. Of the cheapest edits, those whose initials (D, I, K, R) are least in ASCII are taken.

The edits are arcs of a lattice with a node for each state (nothing yet, after s, after u, after a) before each row. Node
prices and a path from the origin are kept so that no arc undercuts the difference of its prices and those
of the path equal it; the path is extended along such an arc, or else its last node's price rises and the path contracts (Bertsekas's
auction algorithm). At the end, arcs that equal the difference of their prices are tight, the shortest paths are the paths of tight
arcs, and the least in ASCII is traced through them.

Rows are numbered in one range sort, and lattices are cut at every CHUNK-th row. A conversation that
lies in one chunk is solved in one lattice; of others, each chunk gives the costs from each state to each, those are the arcs of
lattices of FAN chunks, and so on; what remains to the end comes back down, and each chunk is traced by itself. So the edits of a
very long conversation are found in many tasks; one row for each chunk, and at last its audit, are what meets in
one place. Its hash needs its texts in order: they stream through one task, which keeps no text.

Null conv_id: a conversation of its own. Null role or text: one blank; in the damage, so are null ids. Repeated rows are rows. Other
columns are not read, and an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. NEXT: by role initial, what state it leads to; USER_OR_ASSISTANT: where a new role leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEW = (2, 2, 3, 2)
#: Cost from each state to the end when no row is left, with the rows then to be inserted; and where these are arcs.
AT_END, NO_MORE = [0, 6, 3, 0], [0, None, None, 0]
CHUNK, FAN = 32, 32
#: A row as one character: its role's initial, in upper case if it is truncated, as a digit if it must go.
FREE, TRUNCATED, GONE = "suax", "SUAX", "1234"
INITIAL = {**{c: FREE[i] for i, c in enumerate(GONE)}, **{c: FREE[i] for i, c in enumerate(TRUNCATED)}, **{c: c for c in FREE}}
LEGAL = {"su", "ua", "au"}


Arcs = list[list[tuple[str, int, int]]]


def toward(arcs: Arcs, target: int) -> Arcs:
    """The arcs (label, node, cost) of each node to nodes from which the target can be reached."""
    before: list[list[int]] = [[] for _ in arcs]
    for i, own in enumerate(arcs):
        for _, j, _ in own:
            before[j].append(i)
    reaches, todo = {target}, [target]
    while todo:
        for i in before[todo.pop()]:
            if i not in reaches:
                reaches.add(i)
                todo.append(i)
    return [[x for x in own if x[1] in reaches] for own in arcs]


def auction(arcs: Arcs, price: list[int], origin: int, target: int) -> int | None:
    """The length of the shortest path; None if there is none. arcs: of toward(). price: no arc costs less than its difference of prices; it is changed, and stays so."""
    if not arcs[origin] and origin != target:
        return None
    path = [origin]
    while (node := path[-1]) != target:
        best, to = min([(cost + price[j], j) for _, j, cost in arcs[node]])
        if price[node] < best:
            price[node] = best
            if node != origin:
                path.pop()
        else:
            path.append(to)
    return price[origin] - price[target]


def trace(arcs: Arcs, price: list[int], origin: int, target: int) -> tuple[str, list[int]]:
    """The labels least in ASCII of a path of tight arcs, and its nodes."""
    own = [[x for x in out if price[i] == x[2] + price[x[1]]] for i, out in enumerate(arcs)]
    tight = toward(own, target)
    labels, nodes = [], [origin]
    while nodes[-1] != target:
        label, j, _ = min(tight[nodes[-1]])
        labels.append(label)
        nodes.append(j)
    return "".join(labels), nodes


def lattice(codes: str, last: bool) -> tuple[Arcs, list[int]]:
    """Arcs and first prices of a chunk: nodes 4 * rows read + state; rows may be inserted before each row, and after the last one of a conversation. The price of a node starts as the sum of what each later row costs at least."""
    arcs: Arcs = []
    for i, c in enumerate(codes):
        own = 4 * i
        for q in range(4):
            out = [("D", own + 4 + q, DELETE), ("I", own + NEW[q], INSERT)]
            if c not in GONE:
                cut = CUT if c in TRUNCATED else 0
                if (to := NEXT[q].get(INITIAL[c])) is not None:
                    out.append(("K", own + 4 + to, KEEP + cut))
                out.append(("R", own + 4 + NEW[q], REROLE + cut))
            arcs.append(out)
    arcs += [[("I", 4 * len(codes) + NEW[q], INSERT)] if last else [] for q in range(4)]
    floor = [DELETE if c in GONE else CUT if c in TRUNCATED else 0 for c in codes]
    price = np.repeat(np.append(np.cumsum(floor[::-1])[::-1], 0), 4).astype(int).tolist() if codes else [0] * 4
    return arcs, price


def finished(arcs: Arcs, price: list[int], ends: list[int | None]) -> tuple[Arcs, list[int], int]:
    """The lattice with one node more that the four last ones lead to at the cost of ends (None: not at all), and its number."""
    target, last = len(arcs), len(arcs) - 4
    out = [[*own, ("", target, ends[i - last])] if i >= last and ends[i - last] is not None else own for i, own in enumerate(arcs)]
    # what is to be paid at the end is to be paid from everywhere
    least = min((e for e in ends if e is not None), default=0)
    return toward([*out, []], target), [*(p + least for p in price), 0], target


@functools.lru_cache(100_000)
def whole(codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation that lies in one lattice."""
    arcs, price, target = finished(*lattice(codes, True), NO_MORE)
    return auction(arcs, price, 0, target), trace(arcs, price, 0, target)[0]


def _between(arcs: Arcs, price: list[int]) -> tuple[int | None, ...]:
    """The costs from each of the first four nodes to each of the last four, row by row; None: there is no way."""
    out, last = [None] * 16, len(arcs) - 4
    for to in range(4):
        own, some = price.copy(), toward(arcs, last + to)
        for q in range(4):
            out[4 * q + to] = auction(some, own, q, last + to)
    return tuple(out)


@functools.lru_cache(100_000)
def crossing(codes: str) -> tuple[int | None, ...]:
    """The costs of a chunk from each state to each."""
    return _between(*lattice(codes, False))


def joined(parts: list[tuple[int | None, ...]]) -> tuple[Arcs, list[int]]:
    """The lattice whose arcs are the costs of parts one after the other, and its first prices."""
    arcs = [[("", 4 * (k + 1) + to, cost) for to, cost in enumerate(part[4 * q : 4 * q + 4]) if cost is not None] for k, part in enumerate(parts) for q in range(4)]
    least = [min(x for x in part if x is not None) for part in parts]
    return [*arcs, [], [], [], []], np.repeat(np.append(np.cumsum(least[::-1])[::-1], 0), 4).astype(int).tolist()


def to_the_end(parts: list[tuple[int | None, ...]], ends: list[int | None]) -> list[list[int | None]]:
    """What is to be paid at the end of each part, from each state: the shortest way on to ends after the last one."""
    levels = [parts]
    while len(levels[-1]) > FAN:
        levels.append([_between(*joined(levels[-1][i : i + FAN])) for i in range(0, len(levels[-1]), FAN)])
    after = [ends]  # of the one lattice of all
    for level in reversed(levels):
        out = []
        for k, end in enumerate(after):
            own = level[FAN * k : FAN * (k + 1)]
            arcs, price, target = finished(*joined(own), end)
            out += [[auction(arcs, price, 4 * at + q, target) for q in range(4)] for at in range(1, len(own))] + [end]
        after = out
    return after


@functools.lru_cache(100_000)
def traced(codes: str, ends: tuple[int | None, ...], last: bool) -> tuple[tuple[int | None, str, int], ...]:
    """(cost to the end, edits, state after them) of a chunk, from each state."""
    out = []
    arcs, price, target = finished(*lattice(codes, last), NO_MORE if last else list(ends))
    for q in range(4):
        cost = auction(arcs, price, q, target)
        labels, nodes = trace(arcs, price, q, target) if cost is not None else ("", [0, 0])
        out.append((cost, labels, nodes[-2] % 4))
    return tuple(out)


def illegal(codes: str) -> int:
    """Neighbours whose role initials are none of su, ua, au."""
    initials = [INITIAL[c] for c in codes]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in: by crc32 of `conv_id:turn` modulo 20, 0 drops a row, 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes its role user. A dropped row stays as one whose column there is false, so that no conversation is lost."""
    c, said = F.col, lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    text = F.when(c("kind") == 1, "").when(c("kind") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    own = conversations.select("conv_id", "turn", "role", "text").withColumn("kind", kind)
    own = own.select("conv_id", "turn", F.when(c("kind") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (c("kind") != 0).alias("there"), F.explode(F.array_repeat(F.lit(0), F.when(c("kind") == 3, 2).otherwise(1))).alias("copy"))
    return own.drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, there) without their texts: conv_id, turn, role, digest (of the text), letter (its code if it is the first of its kind), at (its place among all rows that are there)."""
    own = rows.where("there")
    c, last = F.col, F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.coalesce(F.expr("try_element_at(map('s', 1, 'u', 2, 'a', 3), substring(role, 1, 1))"), F.lit(4))
    kind = F.when(last == "", "1234").when(last.isin(".", "!", "?"), "suax").otherwise("SUAX")
    slim = own.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.substring(kind, initial, F.lit(1)).alias("letter"), F.substring(F.lit("1234"), initial, F.lit(1)).alias("gone"))
    ranges = written(slim.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest").withColumns({"range": F.spark_partition_id(), "nth": F.monotonically_increasing_id() % F.lit(1 << 33)}), "turns")
    upto, first = 0, []
    for r in sorted(ranges.groupBy("range").agg(F.count("*").alias("n")).collect()):
        first.append((r["range"], upto))
        upto += r["n"]
    starts = rows.sparkSession.createDataFrame(first, "range int, first long")
    at = ranges.join(F.broadcast(starts), "range").select("conv_id", "turn", "role", "digest", "letter", "gone", (c("first") + c("nth")).alias("at"))
    # the first row of each role and text; later ones are duplicates
    new = at.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    return at.join(new, "at", "left").select("conv_id", "turn", "at", "letter", "gone", (c("new").isNull()).alias("again"))


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit of the conversations of marked()."""
    c = F.col
    blank = c("letter").isin(*GONE)
    code = F.when(c("again"), c("gone")).otherwise(c("letter"))
    rows = rows.select("conv_id", "at", code.alias("code"), blank.cast("long").alias("blank"), (~blank & c("again")).cast("long").alias("duplicate"), (~blank & ~c("again") & c("letter").isin(*TRUNCATED)).cast("long").alias("truncated"))
    faults, kind = ("blank", "duplicate", "truncated"), dict(rows.dtypes)["conv_id"]
    cells = written(rows.groupBy("conv_id", F.floor(c("at") / CHUNK).alias("cell")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes"), *(F.sum(x).alias(x) for x in faults)), "chunks")
    ends = cells.groupBy("conv_id").agg(F.count("*").alias("n"), F.first("codes").alias("codes"), *(F.sum(x).alias(x) for x in faults))
    counted = f"conv_id {kind}, blank long, duplicate long, truncated long"
    out = ends.where("n = 1").select("conv_id", *faults, "codes").mapInArrow(_solved, counted + ", illegal long, cost long, audit string")
    long = written(ends.where("n > 1").select(c("conv_id").alias("id"), *faults), "long-conversations")
    if not long.head(1):
        return out
    parts = cells.join(long, c("conv_id").eqNullSafe(c("id")), "left_semi").select("conv_id", "cell", "codes")
    costs = parts.repartition("conv_id", "cell").mapInArrow(_crossed, f"conv_id {kind}, cell long, codes string, costs array<long>")
    down = costs.groupBy("conv_id").applyInPandas(_ended, f"conv_id {kind}, cell long, codes string, ends array<long>, last boolean")
    back = down.repartition("conv_id", "cell").mapInArrow(_traced, f"conv_id {kind}, cell long, codes string, cost array<long>, edits array<string>, state array<int>")
    found = back.groupBy("conv_id").applyInPandas(_put_together, f"conv_id {kind}, illegal long, cost long, audit string")
    return out.unionByName(found.join(long, c("conv_id").eqNullSafe(c("id"))).drop("id"))


def _solved(batches):
    for b in batches:
        codes = b.column("codes").to_pylist()
        found = [(illegal(x), *whole(x)) for x in codes]
        own = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], *own], [*b.schema.names[:4], "illegal", "cost", "audit"])


def _crossed(batches):
    for b in batches:
        costs = [list(crossing(x)) for x in b.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.list_(pa.int64()))], [*b.schema.names, "costs"])


def _ended(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cell")
    parts = [tuple(None if pd.isna(x) else int(x) for x in costs) for costs in rows["costs"]]
    rows["ends"] = to_the_end(parts, AT_END)
    rows["last"] = np.arange(len(rows)) == len(rows) - 1
    return rows[["conv_id", "cell", "codes", "ends", "last"]]


def _traced(batches):
    for b in batches:
        found = [traced(codes, tuple(ends), last) for codes, ends, last in zip(b.column("codes").to_pylist(), b.column("ends").to_pylist(), b.column("last").to_pylist())]
        own = [pa.array([[x[i] for x in f] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.string(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("cell"), b.column("codes"), *own], ["conv_id", "cell", "codes", "cost", "edits", "state"])


def _put_together(rows: pd.DataFrame) -> pd.DataFrame:
    rows, state, edits = rows.sort_values("cell"), 0, []
    for e, s in zip(rows["edits"], rows["state"]):
        edits.append(e[state])
        state = s[state]
    codes = rows["codes"].tolist()
    wrong = sum(map(illegal, codes)) + sum(illegal(a[-1] + b[0]) for a, b in zip(codes, codes[1:]))
    return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "illegal": [wrong], "cost": [int(rows["cost"].iloc[0][0])], "audit": ["".join(edits)]})


class Repaired:
    """The hash of a repaired conversation, as its rows come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.empty = audit, 0, 0, hashlib.sha256(), True

    def _add(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty, self.state = False, {"s": 1, "u": 2, "a": 3}[role[0]]

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._add(("user", "assistant")[NEW[self.state] - 2], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._add(role, text)
        elif edit == "R":
            self._add(("user", "assistant")[NEW[self.state] - 2], text)

    def hexdigest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows (conv_id, turn, role, text, there) as damaged() gives them; those that are not there only name their conversation."""
    spark, c = conversations.sparkSession, F.col
    small_batches(spark)
    kind = dict(conversations.dtypes)["conv_id"]
    found = audits(marked(conversations))
    turn = F.when(c("there"), c("turn").cast("long"))
    span = conversations.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0)).cast("long").alias("gaps"))
    numbers = ("blank", "duplicate", "truncated", "illegal", "cost")
    heads = span.unionByName(found, allowMissingColumns=True).groupBy("conv_id").agg(F.max("gaps").alias("gaps"), *(F.coalesce(F.max(x), F.lit(0)).cast("long").alias(x) for x in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    own = conversations.where("there").select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    both = heads.withColumn("head", F.lit(0)).unionByName(own.withColumn("head", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "digest").drop("digest", "turn")
    names = ["conv_id", "gaps", *numbers, "audit"]

    def run(batches):
        head, state, out = None, None, []
        for b in batches:
            for row in b.to_pylist():
                if row["head"] == 0:
                    if head:
                        out.append({**head, "repaired_sha256": state.hexdigest()})
                    head, state = {x: row[x] for x in names}, Repaired(row["audit"])
                else:
                    state.row(row["role"], row["text"])
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if head:
            yield pa.RecordBatch.from_pylist([*out, {**head, "repaired_sha256": state.hexdigest()}], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType

    schema = to_arrow_schema(heads.select(*names).schema.add("repaired_sha256", StringType()))
    return both.mapInArrow(run, f"conv_id {kind}, gaps long, {', '.join(f'{x} long' for x in numbers)}, audit string, repaired_sha256 string")
