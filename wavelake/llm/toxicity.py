"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed n-grams (3 to 6 characters, A-Z lower-cased, white space as blanks) that a
text has; each that a text has counts once. r is the log ratio of the shares of toxic and
other training texts with the n-gram; a logistic regression is fitted on features times r
(Wang and Manning's NBSVM). Counts come from tasks by bucket; of 2 ** BITS buckets, the FEATURES
that tell most (G statistic) among those that `least` texts have are kept: the size of the model,
whatever that of the table.

Null and empty texts have the score of no feature. Without labels of both classes every score
is the share of toxic labels (0.5 without any). Repeated rows are scored each; only doc_id,
text and label are read. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, Block, code_points, text_batches
from .common import id_and_text, small_batches
from .labelled import SAMPLE, training_rows

SIZES, BITS, FEATURES, SMOOTH = (3, 4, 5, 6), 18, 4096, 1.0
PLAIN = LOWER.copy()
PLAIN[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def grams(block: Block):
    """(text's number, bucket) arrays of all n-grams, one pair for each n; an n-gram never runs over the end of a text."""
    lead, point = code_points(block.data)
    edges = np.searchsorted(lead, block.off)
    doc, ends = np.repeat(np.arange(block.n), np.diff(edges)), edges[1:]
    data, n = np.where(point < 0x80, PLAIN[np.minimum(point, 0x7F)], point).astype(np.uint32), len(lead)
    left = ends[doc] - np.arange(n)  # characters to the end of the text
    h = np.zeros(n, np.uint32)
    for i in range(min(max(SIZES), n)):
        h[: n - i] = (h[: n - i] ^ data[i:]) * np.uint32(0x01000193)
        if i + 1 in SIZES:
            at = np.flatnonzero(left > i)
            x = h[at]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield doc[at], ((x ^ (x >> np.uint32(13))) * np.uint32(0x297A2D39)) >> np.uint32(32 - BITS)


def present(block: Block, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, bucket) of each distinct bucket of each text; with keep (features by bucket, from 1; 0: none) only those kept, as features."""
    keys = [np.zeros(0, np.int64)]
    for doc, bucket in grams(block):
        value = bucket.astype(np.int64) if keep is None else keep.take(bucket).astype(np.int64)
        if keep is not None:
            own = np.flatnonzero(value)
            doc, value = doc[own], value[own]
        keys.append(doc << BITS | value)
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


class Model:
    """keep: feature of each bucket, from 1 (0: none); weight by feature; bias."""

    def __init__(self, keep: np.ndarray, weight: np.ndarray, bias: float):
        self.keep, self.weight, self.bias = keep, weight, bias

    def __call__(self, texts: pa.Array) -> np.ndarray:
        block = Block(texts)
        z = np.full(block.n, self.bias)
        if len(block.data):
            doc, feature = present(block, self.keep)
            z += np.bincount(doc, self.weight[feature], block.n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_ratios(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The naive Bayes log-count ratio of features that a of n1 and b of n0 texts have."""
    return np.log(((a + SMOOTH) / (n1 + 2 * SMOOTH)) / ((b + SMOOTH) / (n0 + 2 * SMOOTH)))


def _logistic(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, value: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the ridge logistic regression on value[feature], by Adam on all rows."""
    n, f = len(y), len(value)
    w, b, m, v = np.zeros(f), np.log(y.mean() / (1 - y.mean())), np.zeros(f + 1), np.zeros(f + 1)
    x = value[feature]
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[feature] * x, n), -30, 30)))
        e = (p - y) / n
        g = np.append(np.bincount(feature, e[doc] * x, f) + ridge * w / n, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, least: int = 5, ridge: float = 1.0, steps: int = 150) -> Model:
    """A model of label, learned from about sample labelled rows (see labelled.training_rows). least: texts that a bucket is in at least."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, sample).select("label", "text").persist()
    keep = np.zeros(1 << BITS, np.uint16)
    by_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = by_label.get(1, 0), by_label.get(0, 0)
    if not n1 or not n0:
        p = n1 / (n1 + n0) if n1 + n0 else 0.5
        return Model(keep, np.zeros(1), float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        for b in text_batches(batches):
            block, y = Block(b.column(1)), b.column(0).to_numpy()
            if len(block.data):
                doc, bucket = present(block)
                for c in (0, 1):
                    total[c] += np.bincount(bucket[y[doc] == c], minlength=1 << BITS)
        own = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[0][own]), pa.array(total[1][own])], ["bucket", "n0", "n1"])

    counted = rows.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= least).toPandas()
    a, b = counted.n1.to_numpy(float), counted.n0.to_numpy(float)
    gain = np.zeros(len(a))
    for x, total in ((a, n1), (b, n0)):
        for seen, size in ((x, total), (total - x, total)):
            share = (a + b) / (n1 + n0) if seen is x else 1 - (a + b) / (n1 + n0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain += np.where(seen > 0, seen * np.log(seen / (size * share)), 0)
    best = np.lexsort((counted.bucket.to_numpy(), -gain))[:features]
    keep[counted.bucket.to_numpy()[best]] = np.arange(1, len(best) + 1)
    ratio = np.concatenate([[0], log_ratios(a[best], b[best], n1, n0)])

    def matrix(batches):
        for b in text_batches(batches):
            block = Block(b.column(1))
            doc, feature = present(block, keep) if len(block.data) else (np.zeros(0, int), np.zeros(0, int))
            ends = np.searchsorted(doc, np.arange(block.n), "right")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(feature.astype(np.int16)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["label", "features"])

    drawn = rows.mapInArrow(matrix, "label int, features array<short>").toArrow().combine_chunks()
    rows.unpersist()
    lists = drawn["features"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    counts = np.diff(lists.offsets.to_numpy())
    y = drawn["label"].to_numpy().astype(float)
    w, bias = _logistic(np.repeat(np.arange(len(y)), counts), lists.values.to_numpy()[: counts.sum()].astype(np.int64), y, ratio, ridge, steps)
    return Model(keep, w * ratio, float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row. The model is broadcast: its size is fixed."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in text_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value(b.column(1)))], ["doc_id", "score"])

    rows = id_and_text(docs)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
