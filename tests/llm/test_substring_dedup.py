"""Substring deduplication against its definition."""

import hashlib
import random
import re

from wavelake.llm import queries
from wavelake.llm import substring_dedup as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                least[g] = min(d, least.get(g, d))
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - k + 1):
                if least[tuple(w[i : i + k])] < d:
                    gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(8)
    some = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    passages = [some(n) for n in (50, 51, 60, 120, 49, 300)]
    rows = []
    for i in range(90):
        w = some(rnd.randint(0, 120))
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages)
            a = rnd.randrange(max(1, len(p) - 55))
            at = rnd.randint(0, len(w))
            w[at:at] = p[a : a + rnd.choice([50, 55, 80, 400])]
        rows.append((i, rnd.choice([" ", "\n", "\t ", "  "]).join(w)))
    rows += [(100, "x " * 400), (101, "x " * 70), (102, "a b " * 40), (103, "a b " * 60)]  # texts that repeat themselves
    rows += [(i, rows[7][1]) for i in (200, 201, 300)] + [(204, rows[9][1].replace(" ", "\n"))]
    rows += [(400, None), (401, ""), (None, rows[5][1]), (None, rows[7][1]), (6, rows[6][1]), (402, "few words"), (403, "few words"), (404, "é漢 x " * 60), (405, "é漢 x " * 60)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, removed string, part int").repartition(4)
    for k in (50, 20):
        got = queries.substring_digest(s.deduplicated(df, queries.sha256_of, k)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, k)


def test_on_the_small_table(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    want = brute(rows, 50)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, at).collect()), key=str)
    assert got == want and any(r[2] for r in want)


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(s, "PART_PATTERNS", 3)
    rows = corpus()
    got = queries.substring_digest(s.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), queries.sha256_of)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, 50)


def test_a_passage_that_all_documents_share(spark, monkeypatch):
    monkeypatch.setattr(s, "PART_PATTERNS", 2)
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"a{i}x{j}" for j in range(rnd.randint(0, 30))] + passage + [f"b{i}x{j}" for j in range(rnd.randint(0, 30))])) for i in range(300)]
    got = queries.substring_digest(s.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), queries.sha256_of)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, 50)


def test_more_distinct_words_than_characters_exist():
    automaton, words = s.Automaton(50), [f"w{i}" for i in range(1_250_000)]
    for a in range(0, len(words), 50):
        automaton.add(1, " ".join(words[a : a + 10]), " ".join(words[a + 10 : a + 40]), " ".join(words[a + 40 : a + 50]))
    assert len(automaton.numbers) == 1_250_000
    text = ["x", *words[-50:], "y", *words[1_200_000:1_200_049]]
    assert automaton.removed(2, text).tolist() == [False] + [True] * 50 + [False] * 50 and not automaton.removed(1, text).any()


def test_words_whose_sums_cancel_out(spark):
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    twin = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([word] * 50 + ["x"])), (2, " ".join([twin] * 50 + ["y"])), (3, " ".join([twin] * 50 + ["z"]))]
    got = queries.substring_digest(s.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), queries.sha256_of)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, 50)
    assert [r.n_removed for r in sorted(got)] == [0, 0, 50]


def test_empty(spark):
    assert s.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
