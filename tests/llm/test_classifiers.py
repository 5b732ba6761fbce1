"""The two classifiers: held-out accuracy, and their parts against plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa

from wavelake.llm import quality, queries, toxicity
from wavelake.llm.blocks import Block

AT = "/root/testdata/sf0.01"


def held_out(scored, labels, label, least):
    rows = scored.join(labels, "doc_id").collect()
    own = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert own and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in rows)
    return sum(r.predicted == r[label] for r in own) / len(own)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{AT}/labels.parquet")
    scored = queries.op6_quality(spark, AT)
    assert scored.count() == spark.read.parquet(f"{AT}/documents.parquet").count()
    assert held_out(scored, labels, "quality", 0.3) >= 0.97


def test_toxicity_held_out(spark):
    """A small made-up language in which toxic texts have a word with a toxic stem."""
    rnd = random.Random(6)
    rows = []
    for i in range(1500):
        w = ["".join(rnd.choice(["an", "th", "er", "ou", "st"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(20, 60))]
        if toxic := rnd.random() < 0.3:
            w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "moron"]) + rnd.choice(["", "s", "er"]))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scored = queries.predictions(toxicity.score(docs, toxicity.fit(docs, labels)), 0.5)
    assert held_out(scored, labels, "toxic", 0.5) >= 0.97


def test_walk_is_the_trees():
    rnd = np.random.default_rng(1)
    x = rnd.random((500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.grow(x, y, trees=20)
    assert ((t(x) > 0.5) == (y > 0.5)).mean() > 0.95
    for row, got in zip(x[:50], t.margins(x[:50])):
        z = t.base
        for feature, cut, value in zip(t.feature, t.cut, t.value):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            z += value[node]
        assert abs(z - got) < 1e-9


def test_grams_stay_in_their_text():
    texts = ["abcdef", "", "xyz", "ab"]
    alone = [set(map(tuple, [])) for _ in texts]
    for i, t in enumerate(texts):
        alone[i] = set(toxicity.present(Block(pa.array([t])))[1].tolist()) if t else set()
    doc, bucket = toxicity.present(Block(pa.array(texts)))
    assert [set(bucket[doc == i].tolist()) for i in range(4)] == alone and not alone[3]


def test_grams_are_of_characters():
    def bucket(chars):
        h = 0
        for c in chars:
            h = (h ^ ord(" " if c in "\t\n\v\f\r" else c.lower() if c.isascii() else c)) * 0x01000193 % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        return ((h ^ h >> 13) * 0x297A2D39 % 2**32) >> 32 - toxicity.BITS

    texts = ["Été漢字 abc\tÉé", "", "😀😀😀a", "ß", "plain ASCII text"]
    doc, got = toxicity.present(Block(pa.array(texts)))
    for i, t in enumerate(texts):
        assert set(got[doc == i].tolist()) == {bucket(t[j : j + n]) for n in toxicity.SIZES for j in range(len(t) - n + 1)}


def test_weights_are_ratios_times_a_regression(spark):
    """The model's features, counts and ratios against a plain count of the same texts."""
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["good", "fine", "idiot" if i % 3 == 0 else "well"]) for _ in range(4)), int(i % 3 == 0)) for i in range(1, 200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), least=1, features=1 << 16)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    n1, seen = sum(r[2] for r in learned), {}
    for _, t, y in learned:
        for b in set(toxicity.present(Block(pa.array([t])))[1].tolist()):
            seen.setdefault(b, [0, 0])[y] += 1
    assert set(np.flatnonzero(model.keep).tolist()) == set(seen)
    for b, (c0, c1) in seen.items():
        r = toxicity.log_ratios(np.array([c1]), np.array([c0]), n1, len(learned) - n1)[0]
        assert abs(r - np.log((c1 + 1) / (n1 + 2) * (len(learned) - n1 + 2) / (c0 + 1))) < 1e-12
        w = model.weight[model.keep[b]]
        assert w == 0 or r != 0  # a feature without a ratio has no weight


def test_statistics_against_a_plain_version():
    texts = ["One two, two.\nThree!\n\nOne two, two. | {x}", "", "ÄÖ ß漢", "a b c d a b c d a b c d", "LINE\nLINE\nother"]

    def plain(t):
        raw, words = t.encode(), t.split()
        lines = [x for x in t.replace("\r", "\n").split("\n") if x]
        size, many = len(raw), max(1, len(words))
        out = [np.log1p(size)]
        counts = {k: sum(bool(table[b]) for b in raw) for k, table in quality.KINDS.items()}
        out += [c / max(1, size) for c in counts.values()]
        out.append(counts["upper"] / max(1, counts["upper"] + counts["lower"]))
        length = [len(w.encode()) for w in words]
        mean = sum(length) / many
        out += [np.log1p(len(words)), mean, max(0, sum(x * x for x in length) / many - mean**2) ** 0.5, sum(x <= 3 for x in length) / many, sum(x > 12 for x in length) / many]
        out += [sum(bool(quality.KINDS[k][w.encode()[-1]]) for w in words) / many for k in ("symbol", "shout", "stop")]
        top = lambda items: max((items.count(x) for x in items), default=0)
        out += [len(set(words)) / many, top(words) / many]
        four = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
        out += [len(set(four)) / max(1, len(four)), top(four) / max(1, len(four))]
        return out + [np.log1p(len(lines)), size / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines))]

    assert np.allclose(quality.statistics(pa.array(texts)), [plain(t) for t in texts])


def test_first_tree_is_the_best_cut():
    """The root of the first tree against every cut of every feature."""
    rnd = np.random.default_rng(4)
    x = np.round(rnd.random((300, 3)), 2)
    y = ((x[:, 1] > 0.42) ^ (rnd.random(300) < 0.1)).astype(float)
    t = quality.grow(x, y, trees=1)
    g, h = y.mean() - y, np.full(300, y.mean() * (1 - y.mean()))
    gain = lambda own: g[own].sum() ** 2 / (h[own].sum() + 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(3)]
    best = max((gain(x[:, j] <= c) + gain(x[:, j] > c), -j, -c) for j in range(3) for c in edges[j] if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= 1)
    j, c = t.feature[0][0], t.cut[0][0]
    assert np.isclose(gain(x[:, j] <= c) + gain(x[:, j] > c), best[0])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "text", "z"), (3, "a b", "w"), (3, "a b", "w"), (4, "x" * 100_000, "v")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(2, 1, 1), (3, 1, 1), (1, None, None), (None, 0, 0)], "doc_id long, toxic int, quality int")
    for m in (quality, toxicity):
        assert {r.score for r in m.score(docs, m.fit(docs, none)).collect()} == {0.5}
        got = m.score(docs, m.fit(docs, one)).collect()
        assert len(got) == 6 and all(r.score > 0.99 for r in got)
        assert m.score(docs.limit(0), m.fit(docs, one)).count() == 0
