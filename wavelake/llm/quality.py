"""Quality: histogram gradient-boosted trees over statistics of a document.

Statistics (shares of kinds of characters, lengths of words and lines, repetition) are taken
for a whole batch by numpy. Values go to at most BINS quantile bins; each tree is grown level
by level on histograms of gradients, and all are kept as flat arrays (feature, cut and value
of each node, the children of node i at 2i + 1 and 2i + 2), so that a batch walks a level of a
tree in one step. Trees are grown on the driver, on the statistics of about SAMPLE labelled
rows: a table of fixed size.

Null and empty texts have the statistics of no characters. Without labels of both classes
every score is the share of good labels (0.5 without any). Repeated rows are scored each;
only doc_id, text and label are read. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE_WORDS, U64, Block, text_batches
from .common import id_and_text, small_batches
from .labelled import SAMPLE, training_rows

BINS, DEPTH, TREES, RATE = 64, 4, 60, 0.15


def _set(*parts) -> np.ndarray:
    out = np.zeros(256, bool)
    for p in parts:
        out[list(p)] = True
    return out


KINDS = {
    "upper": _set(range(0x41, 0x5B)), "lower": _set(range(0x61, 0x7B)), "digit": _set(range(0x30, 0x3A)), "blank": _set(b" \t"), "line": _set(b"\n\r"), "stop": _set(b".?"), "shout": _set(b"!"),
    "comma": _set(b",;:"), "quote": _set(b"'\"`"), "bracket": _set(b"()[]{}<>"), "bar": _set(b"|\\/_"), "symbol": _set(b"#$%&*+=@^~"), "wide": _set(range(0x80, 0x100)),
}


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    block = Block(texts)
    n = block.n
    size = np.diff(block.off).astype(float)
    some = np.maximum(size, 1)
    out = [np.log1p(size)]
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.off])
    counts = {k: sums(t[block.data]) for k, t in KINDS.items()}
    out += [c / some for c in counts.values()]
    out.append(counts["upper"] / np.maximum(counts["upper"] + counts["lower"], 1))
    words = block.words(SPACE_WORDS)
    count = words.counts.astype(float)
    many = np.maximum(count, 1)
    length = (words.ends - words.starts).astype(float)
    doc = words.docs()
    per = lambda x: np.bincount(doc, x, n)
    mean = per(length) / many
    out += [np.log1p(count), mean, np.sqrt(np.maximum(per(length**2) / many - mean**2, 0)), per(length <= 3) / many, per(length > 12) / many]
    hashes = words.hashes()
    if len(words):
        ends = block.data[words.ends - 1]
        out += [per(t[ends]) / many for t in (KINDS["symbol"], KINDS["shout"], KINDS["stop"])]
    else:
        out += [np.zeros(n)] * 3

    def kinds(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct values, times of the most frequent) of each text."""
        key, times = np.unique((d.astype(U64) << U64(48)) | (h >> U64(16)), return_counts=True)
        own = (key >> U64(48)).astype(np.int64)
        top = np.zeros(n)
        np.maximum.at(top, own, times)
        return np.bincount(own, minlength=n).astype(float), top

    different, top = kinds(hashes, doc)
    out += [different / many, top / many]
    at, h = words.windows(hashes, 4)
    different, top = kinds(h, doc[at])
    windows = np.maximum(np.bincount(doc[at], minlength=n), 1)
    out += [different / windows, top / windows]
    not_line = ~KINDS["line"]
    lines = block.words(not_line)
    rows = np.maximum(lines.counts, 1).astype(float)
    different, top = kinds(lines.hashes(), lines.docs())
    out += [np.log1p(lines.counts), size / rows, different / rows, count / rows]
    return np.stack(out, 1)


class Trees:
    """cuts: of each feature; node arrays of one row for each tree."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.cut, self.value, self.base = feature, cut, value, base

    def margins(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += value[node]
        return z

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees on the logistic loss. A node that has no good cut sends all to its left child, which has its value."""
    n, f = x.shape
    nodes = 2 ** (DEPTH + 1) - 1
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin > b means x > edges[b]
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    z = np.full(n, base)
    all_feature, all_cut, all_value = [], [], []
    flat = bins + np.arange(f) * BINS
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = q - y, q * (1 - q)
        feature, cut, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            start, width = 2**depth - 1, 2**depth
            at = (node - start)[:, None] * (f * BINS) + flat
            hist = [np.bincount(at.ravel(), np.repeat(v, f), width * f * BINS).reshape(width, f, BINS).cumsum(2) for v in (g, h)]
            gl, hl = hist
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain = np.where((hl >= least) & (ht - hl >= least), gain, 0)
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1).max(1) > 1e-6
            for k in np.flatnonzero(good).tolist():
                j, b = divmod(int(best[k]), BINS)
                feature[start + k], cut[start + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
        value[2**DEPTH - 1 :] = (-rate * leaf[0] / (leaf[1] + ridge))[2**DEPTH - 1 :]
        z += value[node]
        all_feature.append(feature)
        all_cut.append(cut)
        all_value.append(value)
    return Trees(np.array(all_feature), np.array(all_cut), np.array(all_value), base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees for label, grown on about sample labelled rows (see labelled.training_rows)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in text_batches(batches):
            s = statistics(b.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), flat], ["doc_id", "label", "x"])

    rows = training_rows(docs, labels, label, sample)
    drawn = rows.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(run, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = drawn.label.to_numpy(float)
    if not len(y) or y.min() == y.max():
        p = y.mean() if len(y) else 0.5
        none = np.zeros((0, 2 ** (DEPTH + 1) - 1))
        return Trees(none.astype(np.int64), none, none, float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))
    return grow(np.stack(drawn.x.to_numpy()), y)


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score (0 to 1) of every row. The trees are broadcast: their size is fixed."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in text_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value(statistics(b.column(1))))], ["doc_id", "score"])

    rows = id_and_text(docs)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def good(docs: DataFrame, model: Trees, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose score is least or more. Rows stay in their partitions."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in text_batches(batches):
            own = shared.value(statistics(b.column(b.schema.get_field_index("text")))) >= least
            yield b.filter(pa.array(own))

    return docs.mapInArrow(run, docs.schema)
