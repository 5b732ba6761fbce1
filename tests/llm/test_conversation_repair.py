"""Conversation repair against a plain version that tries every edit."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from wavelake.llm import conversation_repair as cr
from wavelake.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
ROLE = {2: "user", 3: "assistant"}


def cheapest(rows):
    """(cost, audit, final rows) by memory over places and states; rows: (role, text, gone, truncated)."""

    @functools.cache
    def after(i, q, inserted):
        own = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        step = lambda cost, label, j, to, k, row: [(cost + x[0], label + x[1], ((row,) if row else ()) + x[2]) for x in [after(j, to, k)] if x]
        if inserted < 3:
            own += step(3, "I", i, cr.NEW[q], inserted + 1, (ROLE[cr.NEW[q]], ""))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            own += step(4, "D", i + 1, q, 0, None)
            if not gone:
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
                if to:
                    own += step(3 * cut, "K", i + 1, to, 0, (role, text))
                own += step(3 + 3 * cut, "R", i + 1, cr.NEW[q], 0, (ROLE[cr.NEW[q]], text))
        return min(own, key=lambda x: x[:2], default=None)

    return after(0, 0, 0)


def plain(table, damage=True):
    out = {}
    for conv, turn, role, text in [r[:4] for r in table]:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        own += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    res = []
    for conv, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in own if r[0] is not None]
        seen, rows, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            last = text.rstrip(" \t\n\v\f\r")[-1:]
            k = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if k is not None:
                faults[k] += 1
            rows.append((role, text, k in (0, 1), k == 2))
        wrong = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, final = cheapest(tuple(rows))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        res.append((conv, gaps, *faults, wrong, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()))
    return sorted(res, key=str)


def repaired(spark, table):
    df = spark.createDataFrame(table, SCHEMA).repartition(3) if table else spark.createDataFrame([], SCHEMA)
    return sorted(map(tuple, cr.repair(cr.damaged(df)).collect()), key=str)


def made(seed, convs, longest):
    rnd, out = random.Random(seed), []
    for c in range(convs):
        for t in range(rnd.randint(1, longest)):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", ""]) if rnd.random() < 0.4 else ("user", "assistant")[t % 2]
            out.append((c, t + rnd.choice([0, 0, 0, 1]), role, rnd.choice(["Yes.", "No", "Why?", " ", "", "ok!\n", "Sure. 漢", f"text {t}.", f"text {t}"]), "x"))
    return out


def test_random_conversations(spark):
    table = made(1, 300, 9)
    assert repaired(spark, table) == plain(table)


@pytest.mark.parametrize("chunk,fan", [(2, 2), (5, 3), (32, 32)])
def test_long_conversations_in_chunks(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(cr, "CHUNK", chunk)
    monkeypatch.setattr(cr, "FAN", fan)
    table = made(2, 12, 90)
    assert repaired(spark, table) == plain(table)


def test_chunks_do_not_change_a_path():
    """Levels of lattices against one lattice, also where the first state lasts and ends can't be reached."""
    rnd = random.Random(3)
    for n in range(60):
        codes = "".join(rnd.choice("suaxSUAX1234" if n % 3 else "1xs4X") for _ in range(rnd.randint(1, 50)))
        parts = [codes[i : i + 3] for i in range(0, len(codes), 3)]
        ends = cr.to_the_end([cr.crossing(p) for p in parts], cr.AT_END)
        state, edits, costs = 0, [], []
        for k, (p, e) in enumerate(zip(parts, ends)):
            cost, labels, to = cr.traced(p, tuple(e), k == len(parts) - 1)[state]
            edits.append(labels)
            costs.append(cost)
            state = to
        assert (costs[0], "".join(edits)) == cr.whole(codes)
        rows = [(cr.INITIAL[c], "", c in cr.GONE, c in cr.TRUNCATED) for c in codes]
        assert cr.whole(codes) == cheapest(tuple(rows))[:2]


def test_prices_bound_arcs():
    """No arc undercuts its difference of prices, before and after an auction."""
    rnd = random.Random(4)
    for _ in range(30):
        codes = "".join(rnd.choice("suaxSUAX1234") for _ in range(20))
        arcs, price, target = cr.finished(*cr.lattice(codes, True), cr.NO_MORE)
        fine = lambda: all(price[i] <= cost + price[j] for i, own in enumerate(arcs) for _, j, cost in own)
        assert fine()
        length = cr.auction(arcs, price, 0, target)
        assert fine()
        labels, nodes = cr.trace(arcs, price, 0, target)
        assert sum(next(c for l, j, c in arcs[a] if j == b and l == label) for label, a, b in zip(labels, nodes, nodes[1:])) <= length


def test_odd_rows(spark):
    table = [(None, 1, "user", "Hi.", "a"), (None, None, None, None, "b"), (None, 2, "assistant", "Yes.", "b"), (1, None, "user", "A.", ""), (1, None, "user", "A.", ""), (2, 5, "assistant", "x" * 300_000, ""), (2, 5, "assistant", "y. ", ""), (3, 0, None, "t.", ""), (3, 9, "system", None, "")]
    dropped = next(t for t in range(100) if zlib.crc32(f"77:{t}".encode()) % 20 == 0)
    table.append((77, dropped, "user", "gone.", ""))
    got = repaired(spark, table)
    assert got == plain(table)
    assert (77, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert repaired(spark, []) == []


def test_one_conversation_of_many_rows(spark):
    """A conversation of 20,000 rows goes through its lattices by levels."""
    rnd = random.Random(9)
    table = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice(["Yes.", f"text {t}.", f"text {t}"]), "") for t in range(20_000)]
    (row,) = repaired(spark, table)
    code = {"K": 1, "R": 1, "D": 1, "I": 0}
    kept = [r for r in table if zlib.crc32(f"1:{r[1]}".encode()) % 20]
    twice = sum(zlib.crc32(f"1:{r[1]}".encode()) % 20 == 3 for r in table)
    assert sum(code[e] for e in row[7]) == len(kept) + twice
    assert row[6] == sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in row[7]) + 3 * (row[4] - truncated_deleted(kept, row[7]))


def truncated_deleted(kept, audit):
    """Truncated rows among those deleted, in order."""
    rows, seen, out = [], set(), 0
    for _, t, role, text, _ in kept:
        kind = zlib.crc32(f"1:{t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [("user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for row, edit in zip(rows, audit.replace("I", "")):
        cut = bool(row[1]) and row not in seen and row[1][-1] not in ".!?"
        seen.add(row)
        out += cut and edit == "D"
    return out


def test_query_on_a_whole_table(spark):
    at = "/root/testdata/sf0.01"
    table = [(r.conv_id, r.turn, r.role, r.text, "") for r in spark.read.parquet(f"{at}/conversations.parquet").collect()]
    assert sorted(map(tuple, queries.op11_conversation_repair(spark, at).collect()), key=str) == plain(table)
