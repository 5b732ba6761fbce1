"""Near-duplicate classes against all pairs, and the estimate against the exact likeness."""

import random

import numpy as np
import pyarrow as pa

from wavelake.llm import probminhash as p


def jaccards(a, b):
    """(probability Jaccard, Jaccard) by their definitions."""
    def weights(t):
        w = t.split()
        out = {}
        for g in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []):
            out[g] = out.get(g, 0) + 1
        return out
    x, y = weights(a), weights(b)
    every = set(x) | set(y)
    j = len(set(x) & set(y)) / len(every) if every else 0.0
    if max(x.values(), default=1) == max(y.values(), default=1) == 1:
        return j, j  # with all weights 1 the sum below is this
    return sum(1 / sum(max(x.get(o, 0) / x[g], y.get(o, 0) / y[g]) for o in every) for g in x if g in y), j


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**9)}"
    return " ".join(words)


def corpus():
    rnd = random.Random(5)
    rows, texts = [], []
    for g in range(12):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(30, 150))]
        texts += [edited(rnd, base, n) for n in (0, 0, 1, 1, 2, 4)]
    base = [f"w{rnd.randrange(500)}" for _ in range(200)]
    texts += [edited(rnd, base, 2) for _ in range(60)]  # a large group
    texts += ["short one", "short one", "short two", "", "", " ", "a b c d e", "a b c d e"]
    rnd.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def brute(rows):
    label = {i: i for i, _ in rows}
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, a in rows:
        for j, b in rows:
            if i < j and (a == b or max(jaccards(a, b)) >= 0.8 - 1e-12):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def test_likeness_is_exact():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = (" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 40))) for _ in range(2))
        doc, s, n = p.shingles(pa.array([a, b]))
        assert np.allclose(p.likeness(s[doc == 0], s[doc == 1], n[doc == 0], n[doc == 1]), jaccards(a, b))
        if (n == 1).all():
            assert np.allclose(p.likeness(s[doc == 0], s[doc == 1]), jaccards(a, b))


def test_estimate():
    rnd = random.Random(2)
    base = [rnd.choice([f"w{i}" for i in range(30)]) for _ in range(300)] + ["r", "s", "t", "u", "v"] * 30
    texts = [" ".join(base), edited(rnd, base, 8)]
    doc, s, n = p.shingles(pa.array(texts))
    z = p.signatures(doc, s, n, 2, 4096)
    assert abs((z[0] == z[1]).mean() - jaccards(*texts)[0]) < 0.04


def test_classes_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "short one", "y"), (3, dict(rows)[3], "again")], "doc_id long, text string, id string").repartition(4)
    want = brute(rows)
    for small in (8, 2):
        got = p.near_classes(df, small=small).collect()
        assert len(got) == len(rows) + 2
        assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
        assert [r.class_id for r in got if r.doc_id is None] == [None]
    kept = p.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_large_mixed_buckets_lose_no_link(spark, monkeypatch):
    """Texts of a passage that all share and a part of their own: all are in each other's buckets, few are alike."""
    rnd, texts = random.Random(4), []
    shared = [f"s{i}" for i in range(60)]
    for g in range(60):
        base = shared + [f"g{g}w{rnd.randrange(10**6)}" for _ in range(25)]
        texts += [" ".join(base), edited(rnd, base, 1), " ".join(base + [f"end{g}"] * 4)][: 1 + g % 3]
    texts += [" ".join(shared[:30] + [f"t{i}"] + shared[31:]) for i in range(40)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert 60 < len(set(want.values())) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # one band of one row: nearly all are in one bucket, so all is up to the lists
    for options, block in (({}, 8_000_000), ({"bands": 30, "rows": 1, "small": 2}, 8_000_000), ({"bands": 30, "rows": 1, "small": 2}, 9_000)):
        monkeypatch.setattr(p, "BLOCK", block)
        assert {r.doc_id: r.class_id for r in p.near_classes(df, **options).collect()} == want


def test_links_within_join_what_is_alike():
    rnd, texts = random.Random(12), []
    for g in range(6):
        base = [f"g{g % 3}w{rnd.randrange(40)}" for _ in range(60)]
        texts += [edited(rnd, base, k) for k in (0, 1, 2, 3, 5)] + [" ".join(base + base[:6] * k) for k in (1, 4, 30)]
    doc, s, n = p.shingles(pa.array(texts))
    sets = [s[doc == i] for i in range(len(texts))]
    times = [None if (n[doc == i] == 1).all() else n[doc == i] for i in range(len(texts))]
    links = p.links_within(np.arange(len(texts)), np.arange(len(texts)), sets, times, 0.8)
    assert all(max(jaccards(texts[u], texts[v])) >= 0.8 - 1e-9 and u > v for u, v, _ in links)
    label = list(range(len(texts)))
    for u, v, _ in links:
        label = [label[v] if x == label[u] else x for x in label]
    want = brute(list(enumerate(texts)))
    assert {frozenset(i for i in want if want[i] == c) for c in want.values()} == {frozenset(i for i in want if label[i] == c) for c in label}


def test_one_id_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(4, a, "one"), (4, b, "two"), (4, b, "three"), (9, b, "four"), (3, a + " x", "five"), (None, a, "six")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id or 0, r.text, r.kept in ("two", "three")) for r in p.keep_one(df).collect())
    assert got == [(0, a, False), (3, a + " x", False), (4, b, True)]


def test_weights_beyond_sixteen_bits():
    a, b = np.array([1, 2], np.uint64), np.array([1, 2], np.uint64)
    assert p.likeness(a, b, np.array([100_000, 1]), np.array([65_535, 1]))[0] < 1


def test_empty(spark):
    assert p.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_with_repeated_lines(spark):
    rnd, texts = random.Random(9), []
    for g in range(12):
        base = [f"b{g}w{i}" for i in range(100)]
        line = [f"b{g}l{i}" for i in range(10)]
        texts += [" ".join(base + line * n) for n in (2, 50, 20)] + [edited(rnd, base + line * 30, 3)]
    rows = list(enumerate(texts))
    assert all(jaccards(texts[i], texts[i + 1])[0] < 0.4 and jaccards(texts[i], texts[i + 1])[1] == 1 for i in range(0, len(texts), 4))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in p.near_classes(df).collect()} == brute(rows)


def test_many_short_texts_of_one_shingle():
    """200,000 texts of six words with five in common: no link, and no time for each member that grows with the group."""
    import time


    n = 200_000
    common = np.uint64(7)
    sets = [np.sort(np.array([common, 1000 + i], np.uint64)) for i in range(n)]
    began = time.perf_counter()
    assert p.links_within(np.arange(n), np.arange(n), sets, [None] * n, 0.8) == []
    assert time.perf_counter() - began < 60


def test_links_of_a_group_are_all_pairs():
    """Random sets and multisets against every pair of them: the same classes."""

    for seed in range(12):
        rnd = np.random.default_rng(seed)
        base = rnd.integers(1, 2**62, 40).astype(np.uint64)
        sets, times = [], []
        for _ in range(60):
            own = np.unique(rnd.choice(base[: rnd.integers(2, 40)], rnd.integers(1, 30)))
            sets.append(own)
            times.append(rnd.integers(1, 6, len(own)).astype(np.uint32) if rnd.random() < 0.4 else None)

        def spread(links):
            label = list(range(60))
            for u, v, _ in links:
                a, b = label[u], label[v]
                label = [a if x == b else x for x in label]
            return {frozenset(i for i in range(60) if label[i] == x) for x in label}

        every = [(i, j, 1) for i in range(60) for j in range(i) if max(p.likeness(sets[i], sets[j], times[i], times[j])) >= 0.7 - 1e-12]
        assert spread(every) == spread(p.links_within(np.arange(60), np.arange(60), sets, times, 0.7))
