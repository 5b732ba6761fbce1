"""The base score against its definition; the model's gradient, windows and probabilities."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from wavelake.llm import lm_scoring as m
from wavelake.llm import queries
from wavelake.llm.labelled import fold

RANKS = P.path("byte_bpe_50k.tiktoken")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows):
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 == 1
    c, ends = Counter(), 0
    for d, t in rows:
        if not out(d):
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    p = lambda x: math.log10((x + 0.5) / (n + 0.5 * (v + 1)))
    return [(d, out(d), len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + (ends > 0), n, sum(p(c[w]) for w in words(t)) + p(ends)) for d, t in rows]


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_small_table(spark, monkeypatch):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    monkeypatch.setattr(m, "HEAD", 300)
    got = queries.op5_lm_scoring(spark, at).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], brute(rows))
    assert all(r.score < 0 for r in got)


def held_out_scores(spark, at, rounds):
    docs = spark.read.parquet(f"{at}/documents.parquet").repartition(4)
    return m.log_probabilities(docs, RANKS, fold() == 1, rounds=rounds).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()


def test_the_model_alone_is_better_than_the_base_on_held_out_texts(spark):
    score, base = held_out_scores(spark, "/root/testdata/sf0.1", m.ROUNDS)
    assert score > base


def test_attention_adds_to_the_shares(spark):
    at = "/root/testdata/sf0.01"
    assert held_out_scores(spark, at, m.ROUNDS)[0] > 0.98 * held_out_scores(spark, at, 0)[0]


def test_words_whose_sums_cancel_out(spark):
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    rows = [(1, word), (2, word), (5, word.translate(str.maketrans("ab", "ba")))]
    got = m.log_probabilities(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, F.col("doc_id") == 5, rounds=1).collect()
    assert {r.doc_id: r.n_known for r in got} == {1: 2, 2: 2, 5: 1}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b"), (3, "A b"), (None, "b"), (4, "zzz " * 3000), (5, "unseen Words")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = m.log_probabilities(df, RANKS, fold() == 1, rounds=1).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], brute(rows))
    none = m.log_probabilities(df, RANKS, F.lit(True), rounds=1).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in none)
    assert m.log_probabilities(df.limit(0), RANKS, fold() == 1, rounds=1).count() == 0


def some_model(seed=1):
    """A model of a made-up vocabulary of 1000 ids (and the end), 300 of which begin a word, with random contexts."""
    rnd = np.random.default_rng(seed)
    begins = np.append(rnd.random(1000) < 0.3, True)
    units = m.Units(rnd.integers(0, 1000, 1001), begins)
    of = units.unit[:-1]
    key = np.unique(np.append(of[rnd.integers(0, 1000, 3000)].astype(np.int64) * (m.UNITS + 1) + rnd.choice(np.append(of[~begins[:-1]], m.UNITS), 3000), of[0] * (m.UNITS + 1) + m.UNITS))
    inner = key[key % (m.UNITS + 1) < m.UNITS]
    chosen = np.unique(inner[:200] // (m.UNITS + 1) * m.UNITS + inner[:200] % (m.UNITS + 1))
    within = rnd.choice(np.append(np.unique(units.kind[of[~begins[:-1]]]), m.CLASSES), 500)
    triples = np.unique(rnd.integers(0, len(chosen), 500) * (m.CLASSES + 1) + within)
    shares = m.Shares(units, key, rnd.integers(1, 50, len(key)), chosen, triples, rnd.integers(1, 50, len(triples)))
    flat = m.first_weights().astype(np.float64)
    flat += rnd.normal(0, 0.1, len(flat))
    m.unpack(flat)["e"][m.NONE] = 0
    return m.Model(units, shares, flat), rnd


def some_ids(model, rnd, counts):
    ids = rnd.integers(0, 1000, counts.sum())
    begin = np.flatnonzero(model.units.begins[model.units.unit[:-1]])
    first = (np.cumsum(counts) - counts)[counts > 0]
    ids[first] = rnd.choice(begin, len(first))  # a text begins with the beginning of a word
    return ids


def test_gradient():
    model, rnd = some_model()
    counts = np.array([0, 5, 7, 8, 150])
    p = m.Patches(some_ids(model, rnd, counts), counts, model.units, model.shares)
    for x in ("after", "starts", "factor"):
        setattr(model.shares, x, getattr(model.shares, x).astype(np.float64))
    start, size, _ = p.windows(m.LENGTH)
    _, g = m.gradient(model.flat, p, model.shares, start, size)
    for i in rnd.choice(np.flatnonzero(g), 60):
        e = np.zeros_like(model.flat)
        e[i] = 1e-5
        slope = (m.gradient(model.flat + e, p, model.shares, start, size)[0] - m.gradient(model.flat - e, p, model.shares, start, size)[0]) / 2e-5
        assert slope == pytest.approx(g[i], rel=1e-3, abs=1e-6)


def plain_score(model, ids):
    """log10 of the probability of each of the ids and of the end, one by one from the definition."""
    units, shares, w = model.units, model.shares, m.unpack(model.flat)
    own, out = [*ids, len(units.unit) - 1], []
    unit = [int(units.unit[i]) for i in own]
    patches = [unit[i : i + m.PATCH] for i in range(0, len(own), m.PATCH)]
    for i, u in enumerate(unit):
        patch = i // m.PATCH
        start = 0 if patch < m.LENGTH else -(-(patch - m.LENGTH + 1) // m.STEP) * m.STEP
        x = np.array([w["e"][m.BEFORE] / m.PATCH if j == 0 else sum(w["e"][y] for y in patches[j - 1]) / m.PATCH for j in range(start, patch + 1)])
        e = np.exp(m.hidden(w, x[None])[0][0, -1] @ w["out"] + w["bias"])
        before = unit[i - 1] if i else m.UNITS
        row = shares.first + before
        if i > 1 and not units.begins[before] and (r := shares.rows[unit[i - 2] * m.UNITS + before]) != m.NO_ROW:
            row = r
        z = np.zeros(m.CLASSES)
        z[m.BEGIN : m.BEGIN + m.WITHIN] = shares.after[row, :-1]
        z = (z + shares.after[row, -1] * shares.starts) * e
        out.append(math.log10(z[units.kind[u]] / z.sum()) + float(shares.inner[before, u]) + float(units.share[own[i]]))
    return out


def test_each_id_is_scored_once_by_the_definition():
    model, rnd = some_model()
    counts = np.array([0, 1, 7, 8, 9, 127, 128, 129, 400])
    ids = some_ids(model, rnd, counts)
    p = m.Patches(ids, counts, model.units, model.shares)
    start, size, old = p.windows(m.STEP)
    new = [patch for a, n, o in zip(start, size, old) for patch in range(a + o, a + n)]
    assert sorted(new) == list(range(len(p.size))) and p.size.sum() == len(ids) + len(counts) and set(old) == {0, m.LENGTH - m.STEP}
    lp, ends = m.scored(model, p), np.cumsum(counts + 1)
    upto = np.concatenate([[0], np.cumsum(counts)])
    for d, n in enumerate(counts):
        assert np.allclose(lp[ends[d] - n - 1 : ends[d]], plain_score(model, ids[upto[d] : upto[d + 1]].tolist()), atol=1e-4)


def test_probabilities_add_up_and_look_back_only():
    model, rnd = some_model()
    units, shares = model.units, model.shares
    assert np.allclose(shares.after.sum(1), 1, atol=1e-5) and np.isclose(shares.starts.sum(), 1, atol=1e-5)
    for x in ((10.0 ** shares.inner[5])[units.n > 0], (10.0 ** shares.inner[-1])[units.n > 0]):
        assert (np.bincount(units.kind[units.n > 0], x) <= 1 + 1e-5).all()
    assert np.allclose(np.bincount(units.unit, 10.0**units.share)[np.unique(units.unit)], 1, atol=1e-5)
    ids = some_ids(model, rnd, np.array([300]))
    # what comes later doesn't change what is said of an id
    a, b = (m.scored(model, m.Patches(np.append(ids, x), np.array([301]), units, shares)) for x in (5, 6))
    assert np.allclose(a[:300], b[:300])


def test_every_training_text_is_read_once(spark):
    texts = [f"{a}{b} " * 40 for a in "bcdfg" for b in ("ad", "on", "ist", "er", "um", "et")]
    df = spark.createDataFrame([(t,) for t in texts * 2], "text string").repartition(3)
    rounds = [[r.text for r in m.of_round(df, i, m.ROUNDS).collect()] for i in range(m.ROUNDS)]
    assert sorted(t for own in rounds for t in own) == sorted(texts * 2)
    # a unit that no other text has moves from its first weights with each text
    words = m.counted_words(df)
    model = m.Model(*m.gathered(words, RANKS, len(texts)), m.first_weights())
    read = m.Reader(m.built(RANKS, m._given(df, RANKS)))
    units = [model.units.unit[read(m.pa.array([t]))[3]] for t in texts]
    # all counts of the words' ids are in the shares
    assert model.units.n.sum() == 2 * sum(len(u) for u in units) + len(texts)
    before = model.flat
    for i in range(m.ROUNDS):
        model = m.Model(model.units, model.shares, m.trained(df, RANKS, model, i, m.ROUNDS, 0.03))
    moved = (m.unpack(before)["e"] != m.unpack(model.flat)["e"]).any(1)
    assert all(moved[u].all() for u in units)
    assert model.flat.dtype == np.float32


def test_attention_sees_each_id_before():
    model, rnd = some_model()
    ids = some_ids(model, rnd, np.array([m.LENGTH - 2]))
    lp = m.scored(model, m.Patches(ids, np.array([len(ids)]), model.units, model.shares))
    for at in range(1, len(ids) - 3):
        other = ids.copy()
        other[at] = rnd.choice(np.flatnonzero(model.units.unit[:-1] != model.units.unit[ids[at]]))
        got = m.scored(model, m.Patches(other, np.array([len(ids)]), model.units, model.shares))
        # beyond the two next ids, whose shares it changes
        assert (got[:at] == lp[:at]).all() and (got[at + 3 :] != lp[at + 3 :]).all()


def test_parts_are_all_texts_in_order(monkeypatch):
    monkeypatch.setattr(m, "PART", 10)
    counts = np.array([0, 3, 7, 25, 0, 0, 9, 1, 1, 0])
    got = list(m.parts(np.arange(counts.sum()), counts))
    assert np.concatenate([ids for ids, _ in got]).tolist() == list(range(counts.sum()))
    assert np.concatenate([n for _, n in got]).tolist() == counts.tolist()
    assert all(len(ids) == n.sum() and (len(ids) <= 10 or np.count_nonzero(n) == 1) for ids, n in got)
