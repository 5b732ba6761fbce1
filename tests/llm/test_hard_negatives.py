"""Hard negatives against all pairs, in SQL and in Python."""

import random

import numpy as np
import pytest

from wavelake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def plain(rows, every, positives=5, negatives=10):
    own = []
    for i, (vec_id, x, label, _) in enumerate(rows):
        if label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        own.append((i, vec_id, label, [int(np.floor(256 * float(np.float32(v)))) for v in x]))
    out = []
    for i, vec_id, label, x in own:
        if vec_id is None or vec_id % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(x, y)), v if v is not None else 1 << 62, j, l) for j, v, l, y in own if j != i)
        for p, pid, pj, _ in [r for r in s if r[3] == label][:positives]:
            fit = [r for r in s if r[3] != label and 30 * -p <= 100 * -r[0] <= 90 * -p][:negatives]
            out += [(vec_id, pid if pid < 1 << 62 else None, k, r[1] if r[1] < 1 << 62 else None, -p, -r[0]) for k, r in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=10):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
    return sorted(map(tuple, hn.mine(hn.usable(df), hn.F.col("id") % every == 0).collect()), key=str)


@pytest.mark.parametrize("seed,dims,copies", [(1, 12, 1), (2, 40, 30), (3, 3, 5)])
def test_equal_to_all_pairs(spark, monkeypatch, seed, dims, copies):
    """Small blocks, so that thresholds of earlier blocks count; ties of equal vectors."""
    monkeypatch.setattr(hn, "ROWS", 64)
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(300 // copies, dims)).repeat(copies, 0).astype(np.float32) * 0.2
    rows = [(i, v.tolist(), int(rnd.integers(0, 4)), "x") for i, v in enumerate(x)]
    assert mined(spark, rows) == plain(rows, 10)


def test_waves_are_one(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=6).tolist(), int(rnd.integers(0, 3)), "") for i in range(200)]
    want = mined(spark, rows)
    monkeypatch.setattr(hn, "WAVE", 600)
    assert mined(spark, rows) == want == plain(rows, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1, "a"), (10, [1.0, None], 1, "a"), (20, None, 1, "a"), (30, [nan, 1.0], 1, "a"), (40, [inf, 1.0], 1, "a"), (50, [1.0, 1.0], None, "a"), (None, [1.0, 1.5], 1, "a"), (60, [], 1, "a"), (70, [], 2, "b"),
            (3, [1.0, 1.0, 9.0], 1, "a"), (4, [0.5, 0.9], 2, "b"), (4, [0.5, 0.9], 2, "b"), (None, [0.5, 0.8], 2, "b"), (80, [3e6, -3e6], 3, "c"), (81, [3e6, 3e6], 3, "c"), (82, [2e6, -1.0], 4, "c")]
    got = mined(spark, rows)
    assert got == plain([(a, [v for v in b] if b else b, c, d) for a, b, c, d in rows], 10) and got
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1, "x")]) == []


def test_the_bitmap_shrinks():
    """Most candidates leave before the last dimension where a vector's magnitudes fall off."""
    rnd = np.random.default_rng(7)
    x = (rnd.normal(size=(2000, 64)) * 200 * 0.8 ** np.arange(64)).astype(np.int16).T
    labels = np.zeros(2000, np.int64)
    c = hn.Columns({"bytes": 2, "labels": labels.tobytes(), "ids": np.arange(2000).tobytes(), "none": np.zeros(2000, bool).tobytes(), "marks": np.zeros(2000, bool).tobytes(), "block": 0, "n": 2000, "x": np.ascontiguousarray(x).tobytes()})
    left = []

    def bounds(low, high):
        left.append(len(low))
        return hn.kth(low, 5), np.inf

    own, score = c.scan(x[:, 0].astype(np.int64), np.arange(2000), bounds)
    every = x.astype(np.int64).T @ x[:, 0].astype(np.int64)
    assert left[0] == 2000 and left[-1] < 200 and set(np.argsort(-every)[:5]) <= set(own.tolist()) and (score == every[own]).all()


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, at):
    import duckdb

    from wavelake.llm import queries

    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{at}/embeddings.parquet'")
    got = queries.op12_hard_negatives(spark, at)
    want = c.sql(hn.ORACLE)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
