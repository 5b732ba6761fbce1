"""Contamination against a brute-force scan."""

import hashlib
import random
import re

import pytest

from wavelake.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[j : j + 13]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for j in range(len(w) - k + 1):
                if (own := grams.get(tuple(w[j : j + k]))) is not None:
                    hit.update(range(j, j + k))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.contamination_digest(df).collect()), key=str)


@pytest.mark.parametrize("most,size", [(500_000, 1 << 26), (7, 1 << 26), (500_000, 50)])
def test_against_brute_force(spark, most, size):
    rnd = random.Random(3)
    some = lambda n: " ".join(rnd.choice(["ab", "Cd", "é", "x1", "the", "漢字"]) + rnd.choice(["", "", ",", "\n"]) for _ in range(n))
    items = [(i, some(rnd.choice([0, 2, 13, 14, 30]))) for i in range(12)] + [(12, None), (13, "The"), (None, some(20))]
    docs = [(i, some(rnd.randint(0, 60)) + " " + (rnd.choice(items)[1] or "") + "." + some(rnd.randint(0, 30))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, items[3][1]), (7, "again"), (7, "again")]
    a = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, hits string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert digest(decontamination.contamination(a, b, most_windows=most, most_bytes=size)) == brute(docs, [x for x in items if x[0] is not None])


def test_empty(spark):
    a, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(a, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert digest(decontamination.contamination(one, b)) == brute([(1, "a b")], [])


@pytest.mark.parametrize("most", [500_000, 7])
def test_items_of_one_preamble(spark, monkeypatch, most):
    """Windows that thousands of items share: the results are whole, and no item id is broadcast."""
    preamble = " ".join(f"p{i}" for i in range(30))
    items = [(i, f"{preamble} own{i % 50}") for i in range(3000)] + [(5000, "other " * 14)]
    docs = [(i, f"{preamble} own{i} and more") for i in range(40)] + [(40, f"x {preamble} y " * 3), (41, "other " * 20), (42, "nothing of it"), (40, None)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(4)
    sent = []
    scan = decontamination.scan
    monkeypatch.setattr(decontamination, "scan", lambda d, rows: sent.append(rows.value) or scan(d, rows))
    assert digest(decontamination.contamination(a, b, most_windows=most)) == brute(docs, items)
    if most > 7:
        assert len(sent[0]) == 18 + 50 + 1 and len({id(owners) for _, owners in sent[0]}) == len({owners for _, owners in sent[0]}) == 52
