"""Language ID against a plain version, on mixed texts, and on held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavelake.llm import language_id as li
from wavelake.llm import queries
from wavelake.llm.blocks import Block

WORDS = {"aa": ["thing", "other", "with", "and", "the"], "bb": ["école", "être", "les", "où", "ça"], "cc": ["größe", "zwölf", "und", "schön", "mit"]}


def text(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def bucket(g):
    h = 0
    for c in g:
        h = (h ^ ord(c)) * 0x01000193 % 2**32
    h ^= len(g) * 0x9E3779B1 % 2**32
    h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
    return ((h ^ h >> 13) * 0x297A2D39 % 2**32) >> 32 - li.BITS


def plain_grams(t):
    s = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " "
    own = [s[i : i + n] for n in li.SIZES for i in range(len(s) - n + 1)] if s.strip() else []
    return Counter(bucket(g) for g in own)


def test_grams_against_a_plain_version():
    texts = ["The cat", "", None, "  ÉTÉ 12 été!", "a", "... 5", "漢字 и 😀x", "x\ty\n\nz"]
    doc, b, n = li.grams(Block(pa.array(texts)))
    for i, t in enumerate(texts):
        assert dict(zip(b[doc == i].tolist(), n[doc == i].tolist())) == dict(plain_grams(t or ""))


def test_mixtures_against_a_plain_version():
    """Shares, sets and their penalised likelihood, text by text in Python."""
    rnd = np.random.default_rng(2)
    p = rnd.dirichlet(np.ones(50), 3).T
    texts, langs = 40, 3
    counts = []
    for i in range(texts):
        mix = rnd.dirichlet(np.full(langs, 0.2))
        counts.append(rnd.multinomial(rnd.integers(1, 300), p @ mix))
    doc, own = np.nonzero(np.array(counts))
    n = np.array(counts)[doc, own].astype(float)
    chosen, every = li.mixtures(p[own], n, doc, texts)

    def fit(c, some):
        share = [1 / len(some)] * len(some)
        seen = [(g, k) for g, k in enumerate(c) if k]
        for _ in range(li.ROUNDS):
            new = [0.0] * len(some)
            for g, k in seen:
                z = sum(s * p[g, m] for s, m in zip(share, some))
                for j, m in enumerate(some):
                    new[j] += k * share[j] * p[g, m] / z
            share = [x / sum(c) for x in new]
        return share, sum(k * math.log(sum(s * p[g, m] for s, m in zip(share, some))) for g, k in seen)

    for i, c in enumerate(counts):
        whole, _ = fit(c, [0, 1, 2])
        assert np.allclose(whole, every[i])
        order = sorted(range(3), key=lambda m: -whole[m])
        sets = [[max(range(3), key=lambda m: sum(k * math.log(p[g, m]) for g, k in enumerate(c) if k))], order[:2], order]
        fits = [fit(c, s) for s in sets]
        value = [f[1] - len(s[1:]) * li.PENALTY * math.log(sum(c)) for f, s in zip(fits, sets)]
        best = int(np.argmax(value))
        want = np.zeros(3)
        want[sets[best]] = fits[best][0]
        assert np.allclose(want, chosen[i])


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, lang, rnd.randint(5, 40)), lang, "s") for i, lang in enumerate(rnd.choices(list(WORDS), k=300))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_sets_of_mixed_texts(spark, corpus):
    rnd = random.Random(2)
    model = li.fit(corpus, F.lit(True))
    mixed = [(i, text(rnd, a, 60) + ". " + text(rnd, b, 30), a, b) for i, (a, b) in enumerate([("aa", "bb"), ("bb", "aa"), ("cc", "aa"), ("aa", "aa"), ("cc", "cc")])]
    got = {r.doc_id: r for r in li.predict(spark.createDataFrame([r[:2] for r in mixed], "doc_id long, text string"), model).collect()}
    for i, _, a, b in mixed:
        assert got[i].lang_pred == a and set(got[i].languages) == {a, b} and got[i].languages[0] == a and abs(sum(got[i].proportions) - 1) < 1e-6
        assert 0.5 < got[i].score <= 1


def test_odd_rows(spark, corpus):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 .. !", "aa"), (None, "the other thing", None), (4, "the other thing", "zz"), (4, "the other thing", "zz"), (5, "être " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in li.predict(docs, li.fit(corpus, F.lit(True))).collect()))
    assert got == [(0, "aa"), (1, "und"), (2, "und"), (3, "und"), (4, "aa"), (4, "aa"), (5, "bb")]
    none = li.predict(docs, li.fit(corpus, F.lit(False))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert li.predict(docs.limit(0), li.fit(corpus, F.lit(True))).count() == 0
    assert {r.lang_pred for r in li.predict(docs, li.fit(docs.where("doc_id = 4"), F.lit(True))).where("doc_id > 3").collect()} == {"zz"}


def test_counts_are_of_all_texts(corpus):
    """The counts that tasks sum against one count of everything."""
    total = {}
    for r in corpus.collect():
        total.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    for r in li.counts(corpus.select("text", "lang")).collect():
        c = np.frombuffer(r["counts"], np.int64)
        assert all(c[i] == total[r.lang].get(r.slab * li.SLAB + i, 0) for i in range(li.SLAB))


def test_query_on_held_out_rows(spark):
    at = "/root/testdata/sf0.01"
    got = queries.op13_language_id(spark, at).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    assert len(got) == len(lang)
    own = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) / len(own) >= 0.97
