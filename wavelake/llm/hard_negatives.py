"""Hard negatives by a vertical scan of columnar vectors (BOND, de Vries et al. 2002).

Vectors lie in blocks, one array for each dimension, with the least and greatest value of each. For an
anchor, a block's dimensions are read in descending order of the anchor's magnitudes, STEP at a time. What the
dimensions still to come can add at least and at most bounds each row's score; rows that can't come among the best or
into a window leave the candidate bitmap, and those left at the end have exact scores.

Rows with a null label, a null vector or a null or non-finite component take no part. A
component counts as floor(scale * x); vectors of different lengths meet as if zeros followed the
shorter one. Repeated rows are rows of their own. Rows without an id are no anchors and come last among equals. An
empty table gives an empty result; other columns are not read.

Anchors are a stated query set. They are broadcast in waves of about WAVE bytes, and each wave scans
all blocks; a task keeps the best few of each anchor over all its blocks, and a window keeps the best of all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, written

#: Rows of a block, dimensions read between two looks at the bounds, bytes of anchors broadcast at once (on average: anchors fall into waves by hash).
ROWS, STEP, WAVE = 4096, 8, 16 << 20
#: Sums of smaller magnitude are exact as doubles.
EXACT = 2**53


def usable(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """id, label and the whole components of the rows that take part; vectors: vec_id, embedding, label."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = vectors.where(F.col("label").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return own.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("x"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """Columnar blocks of rows (id, label, x, anchor): ids, labels, marks of anchors, and the dimensions one after the other. A row of the table is told apart by its block and place."""

    def packed(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        own = [part.column(i).combine_chunks() for i in range(4)]
        x = matrix(own[2]).T
        most = int(np.abs(x).max(initial=0))
        kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
        ids, none, marks = own[0].fill_null(2**63 - 1).to_numpy(), own[0].is_null().to_numpy(zero_copy_only=False), own[3].fill_null(False).to_numpy(zero_copy_only=False)
        values = [ids, none, own[1].to_numpy(), marks, np.ascontiguousarray(x, kind)]
        return pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([np.dtype(kind).itemsize], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], ["n", "bytes", "ids", "none", "labels", "marks", "x"])

    def pack(batches):
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                held.append(b.slice(at, ROWS))
                n += held[-1].num_rows
                if n >= ROWS:
                    yield packed(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    said = "n int, bytes int, ids binary, none binary, labels binary, marks binary, x binary"
    return rows.select("id", "label", "x", "anchor").mapInArrow(pack, said).withColumn("block", F.monotonically_increasing_id())


def marked(at: DataFrame) -> DataFrame:
    """key, id, label, x of the anchors of a table of blocks."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                c = Columns(row)
                own = np.flatnonzero(c.marks)
                yield pa.RecordBatch.from_arrays([pa.array(c.row[own]), pa.array(c.ids[own], mask=c.none[own]), pa.array(c.labels[own]), pa.array(list(c.whole[:, own].T.astype(np.int64)), pa.list_(pa.int64()))], ["key", "id", "label", "x"])

    return at.mapInArrow(run, "key long, id long, label long, x array<long>")


class Columns:
    """A block in a task. Rows lie in order of their labels, so those of one are a slice; whole[d]: dimension d, x[d]: that as doubles."""

    def __init__(self, row: dict):
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[row["bytes"]]
        labels = np.frombuffer(row["labels"], np.int64)
        order = np.argsort(labels, kind="stable")
        self.labels, self.ids, self.none = labels[order], np.frombuffer(row["ids"], np.int64)[order], np.frombuffer(row["none"], bool)[order]
        self.marks = np.frombuffer(row["marks"], bool)[order]
        self.row = row["block"] << 20 | order
        self.whole = np.frombuffer(row["x"], kind).reshape(-1, row["n"])[:, order]
        self.least, self.most = self.whole.min(1).astype(np.int64), self.whole.max(1).astype(np.int64)
        self.x = self.whole.astype(np.float64)

    def scan(self, anchor: np.ndarray, own: np.ndarray, bounds) -> tuple[np.ndarray, np.ndarray]:
        """(places of rows left, their exact scores) of the candidates own. bounds(lows, highs) gives the least and greatest score still wanted, from what each candidate scores at least and at most."""
        dims = min(len(anchor), len(self.x))
        order = np.argsort(-np.abs(anchor[:dims]), kind="stable")
        a = anchor[order]
        ends = np.sort(np.stack([a * self.least[order], a * self.most[order]]), 0)
        left = np.concatenate([np.cumsum(ends[:, ::-1], 1)[:, ::-1], np.zeros((2, 1), np.int64)], 1)  # what dimensions from each place on add
        exact = int(np.abs(left).max(initial=0)) < EXACT
        score = np.zeros(len(own), np.float64 if exact else np.int64)
        for at in range(0, dims, STEP):
            some = order[at : at + STEP]
            x = self.x if exact else self.whole
            x = x[some] if len(own) == x.shape[1] else x[np.ix_(some, own)]
            score += a[at : at + STEP].astype(score.dtype) @ x.astype(score.dtype, copy=False)
            rest = left[:, min(at + STEP, dims)]
            low, high = bounds(score + rest[0], score + rest[1])
            keep = (score + rest[1] >= low) & (score + rest[0] <= high)
            if not keep.all():
                own, score = own[keep], score[keep]
            if not len(own):
                break
        return own, score.astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, then id, then row."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((row[some], ids[some], -score[some]))[:k]]
    return np.lexsort((row, ids, -score))[:k]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest value; of fewer, minus infinity."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class Best:
    """The first k (score, id, whether it has none, row) of each key, over all blocks of a task."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, key, score, ids, none, row) -> None:
        new = np.stack([score, ids, none.astype(np.int64), row]) if len(score) else np.zeros((4, 0), np.int64)
        new = new[:, best(new[0], new[1], new[3], self.k)]
        if key in self.of:
            new = np.concatenate([self.of[key], new], 1)
            new = new[:, best(new[0], new[1], new[3], self.k)]
        self.of[key] = new

    def least(self, key) -> float:
        """What a score must reach to come among the first k, as far as known."""
        own = self.of.get(key)
        return -np.inf if own is None or own.shape[1] < self.k else own[0, -1]

    def batches(self, names: list[str]):
        keys = [(k, x) for k, x in self.of.items() if x.shape[1]]
        for at in range(0, len(keys), 1000):
            some = keys[at : at + 1000]
            x, n = np.concatenate([x for _, x in some], 1), [x.shape[1] for _, x in some]
            key = np.repeat(np.array([k for k, _ in some], np.int64).reshape(len(some), -1), n, 0)
            own = [pa.array(key[:, i]) for i in range(key.shape[1])] + [pa.array(x[0]), pa.array(x[1], mask=x[2].astype(bool)), pa.array(x[3])]
            yield pa.RecordBatch.from_arrays(own, names)


def positives_in(block: Columns, anchors: list, found: Best) -> None:
    """Adds a block's rows of each anchor's label, without the anchor's own row."""
    for key, label, x, row in anchors:  # an anchor's key is its row
        first, last = np.searchsorted(block.labels, [label, label + 1])
        own = np.arange(first, last)
        own = own[block.row[own] != row]
        if len(own):
            least = found.least(key)
            left, score = block.scan(x, own, lambda low, high: (max(least, kth(low, found.k)), np.inf))
            found.add(key, score, block.ids[left], block.none[left], block.row[left])


def windows_of(positive_scores: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
    """(positive score, least, greatest score of a negative) for each distinct score that some score fits."""
    out = [(p, -(-low * p // 100), high * p // 100) for p in sorted(set(positive_scores))]
    return [x for x in out if x[1] <= x[2]]


def negatives_in(block: Columns, anchors: list, found: Best) -> None:
    """Adds a block's rows of other labels than each anchor's within its windows."""
    everything = np.arange(len(block.labels))
    for key, label, x, windows in anchors:
        if not windows:
            continue
        first, last = np.searchsorted(block.labels, [label, label + 1])
        own = np.delete(everything, slice(first, last))
        known = [max(lo, found.least((key, p))) for p, lo, _ in windows]
        top = max(hi for _, _, hi in windows)

        def bounds(low, high):
            # rows that are in a window for sure raise the least score wanted of it
            sure = (kth(low[(low >= lo) & (high <= hi)], found.k) for _, lo, hi in windows)
            return min(max(k, s) for k, s in zip(known, sure)), top

        left, score = block.scan(x, own, bounds)
        for p, lo, hi in windows:
            inside = np.flatnonzero((score >= lo) & (score <= hi))
            if len(inside):
                at = left[inside]
                found.add((key, p), score[inside], block.ids[at], block.none[at], block.row[at])


def _scanned(at: DataFrame, anchors: list, step, k: int, names: list[str]) -> DataFrame:
    """The best of each task; anchors: a broadcast list of one wave."""
    shared = at.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        found = Best(k)
        for b in batches:
            for row in b.to_pylist():
                step(Columns(row), shared.value, found)
        yield from found.batches(names)

    return at.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """rows of usable(). For each row of which anchor is true (an expression on id) and each of its first `positives` other rows of its label: the first `negatives` rows of other labels whose score is low to high percent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    small_batches(spark)
    at = written(blocks(rows.withColumn("anchor", anchor)), "vectors")
    chosen = written(marked(at), "anchors")
    waves = -(-(chosen.agg(F.sum(F.size("x") + 4)).first()[0] or 0) * 8 // WAVE)
    out = []
    for wave in range(waves):
        drawn = chosen.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).toArrow().combine_chunks()
        own = [(key, label, np.array(x, np.int64), key) for key, label, x in zip(*(drawn[c].to_pylist() for c in ("key", "label", "x")))]
        near = written(_first(_scanned(at, own, positives_in, positives, ["key", "score", "id", "row"]), ["key"], positives).drop("rank"), "positives")
        scores: dict[int, list[int]] = {}
        for r in near.select("key", "score").toLocalIterator():
            scores.setdefault(r.key, []).append(r.score)
        wanted = [(key, label, x, windows_of(scores.get(key, []), low, high)) for key, label, x, _ in own]
        far = _first(_scanned(at, wanted, negatives_in, negatives, ["key", "positive_score", "score", "id", "row"]), ["key", "positive_score"], negatives)
        pairs = near.select("key", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"), F.col("row").alias("positive_row"))
        out.append(pairs.join(far.select("key", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["key", "positive_score"]))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.join(chosen.select("key", F.col("id").alias("anchor_id")), "key").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The mining query in plain SQL, over all pairs.
ORACLE = """WITH v AS (SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
