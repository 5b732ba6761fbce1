"""Language ID for texts of several languages: a mixture of n-gram models fitted to each text by expectation-maximisation.

A text's n-grams (2 and 3 characters; letters in lower case, a blank between words and at both ends) are
seen as drawn from a mixture of the languages' models. Expectation-maximisation estimates the share of each language; of the
nested sets of languages in order of their shares, the one of greatest likelihood less PENALTY * ln(n-grams) for each language beyond
the first is the text's set (after Lui, Lau and Baldwin's mixture of languages, with a penalty in place of their greedy
search). The prediction is the language of the greatest share in it, its name deciding ties; the score is its share in the mixture of all languages.

A language's model mixes its n-gram shares with those of all languages (BACKGROUND), so that what no language has seen speaks for none.
N-grams are counted in all texts learned from, as 2 ** BITS hash buckets: each task sums its own, and sums meet by language and slab of buckets.

Null texts and texts without a letter are `und` with score 0, and so is all where nothing was learned. Repeated rows are predicted each; only
doc_id, text and lang are read. An empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, code_points, text_batches
from .common import small_batches

BITS, SIZES, SLAB, BACKGROUND, PENALTY, ROUNDS = 16, (2, 3), 4096, 0.05, 4.0, 10
#: Tasks whose counts meet first.
TOGETHER = 256
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """The lower case of each code point that is a letter or a combining mark within a word, 0x20 for others."""
    out = np.full(0x110000, 0x20, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, bucket, count) of the distinct n-grams of each text, in order of the texts. A text without a letter has none."""
    lead, point = code_points(block.data)
    edges = np.searchsorted(lead, block.off)
    has = np.diff(edges) > 0
    # a blank before and after each text; runs of blanks are one
    doc = np.repeat(np.arange(block.n), np.diff(edges) + 2 * has)
    data = np.full(len(doc), 0x20, np.uint32)
    inside = np.ones(len(doc), bool)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    inside[first] = False
    inside[np.append(first[1:], len(doc))[: len(first)] - 1] = False
    data[inside] = letters()[point]
    blank = data == 0x20
    keep = ~blank
    keep[first] = True
    keep[1:] |= blank[1:] & ~blank[:-1]
    data, doc = data[keep], doc[keep]
    # at the edge of two texts, a closing and an opening blank stand side by side
    wide = np.uint32 if block.n <= 1 << 32 - BITS else np.int64
    keys = [np.zeros(0, wide)]
    h = np.zeros(len(data), np.uint32)
    for n in range(1, max(SIZES) + 1):
        at = np.arange(len(data) - n + 1)
        h = (h[: len(at)] ^ data[n - 1 :]) * np.uint32(0x01000193)
        if n not in SIZES:
            continue
        own = doc[at] == doc[at + n - 1]
        x = h[own] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0x297A2D39)
        keys.append(doc[at[own]].astype(wide) << wide(BITS) | (x >> np.uint32(32 - BITS)).astype(wide))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    key = key.astype(np.int64)
    return key >> BITS, key & ((1 << BITS) - 1), count


def counts(rows: DataFrame) -> DataFrame:
    """lang, slab, counts (SLAB little-endian 64-bit integers) of the n-grams of rows (text, lang)."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in text_batches(batches):
            langs, block = b.column(1).dictionary_encode(), Block(b.column(0))
            if not len(block.data):
                continue
            doc, bucket, n = grams(block)
            code = langs.indices.to_numpy()[doc]
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = code == i
                total[lang] = total.get(lang, 0) + np.bincount(bucket[own], n[own], 1 << BITS).astype(np.int64)
        for lang, x in total.items():
            slabs = x.reshape(-1, SLAB)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slabs), pa.string()), pa.array(range(len(slabs)), pa.int32()), pa.array([s.tobytes() for s in slabs], pa.binary())], ["lang", "slab", "counts"])

    said = "lang string, slab int, counts binary"
    by_task = rows.mapInArrow(count, said).withColumn("part", (F.spark_partition_id() / TOGETHER).cast("int"))
    return added(added(by_task, "lang", "slab", "part"), "lang", "slab")


def added(slabs: DataFrame, *keys: str) -> DataFrame:
    """The sums of slabs of the same keys, a batch at a time."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLAB, np.int64)
        for b in batches:
            for x in b.column(b.schema.get_field_index("counts")):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lang", "slab", "counts"])

    return slabs.groupBy(*keys).applyInArrow(add, "lang string, slab int, counts binary")


class Model:
    """langs by name; p[bucket, language]: probability of an n-gram in a language."""

    def __init__(self, langs: list[str], counted: np.ndarray):
        """counted[language, bucket]"""
        total = counted.sum(0)
        background = (total + 1) / (total.sum() + total.size)
        own = counted / np.maximum(counted.sum(1, keepdims=True), 1)
        self.langs, self.p = langs, np.ascontiguousarray(((1 - BACKGROUND) * own + BACKGROUND * background).T, np.float32)


def shares(p: np.ndarray, n: np.ndarray, doc: np.ndarray, texts: int, allowed: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for all texts at once: (share of each language in each text, log-likelihood). p, n, doc: probabilities, count and text of each n-gram, in order of the texts, each of which has one; allowed: which languages a text may have."""
    starts = np.searchsorted(doc, np.arange(texts))
    total = np.add.reduceat(n, starts)
    share = np.ones((texts, p.shape[1]), p.dtype) if allowed is None else allowed.astype(p.dtype)
    share /= share.sum(1, keepdims=True)
    some = n.astype(p.dtype)
    for _ in range(rounds):
        joint = share[doc]
        joint *= p
        joint *= (some / np.einsum("ij->i", joint))[:, None]
        share = (np.add.reduceat(joint, starts, 0, np.float64) / total[:, None]).astype(p.dtype)
    mixed = np.einsum("ij,ij->i", p, share[doc])
    return share.astype(float), np.add.reduceat(n * np.log(mixed), starts)


def mixtures(p: np.ndarray, n: np.ndarray, doc: np.ndarray, texts: int, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(share of each language in the chosen set of each text, its share in the mixture of all languages)."""
    starts = np.searchsorted(doc, np.arange(texts))
    every, best_of_all = shares(p, n, doc, texts)
    alone = np.add.reduceat(n[:, None] * np.log(p), starts, 0)
    cost = penalty * np.log(np.add.reduceat(n, starts))
    # by share; the better language alone, then the earlier name, decide between equals
    order = np.lexsort((np.broadcast_to(np.arange(p.shape[1]), every.shape), -alone, -np.round(every, 9)), axis=1)
    single = alone.argmax(1)
    chosen, value = np.zeros_like(every), alone.max(1)
    chosen[np.arange(texts), single] = 1
    k = 2
    open_ = np.flatnonzero(best_of_all - cost > value) if p.shape[1] > 1 else np.zeros(0, int)
    while len(open_):
        allowed = np.zeros((len(open_), p.shape[1]), bool)
        np.put_along_axis(allowed, order[open_, :k], True, 1)
        own = np.flatnonzero(np.isin(doc, open_))
        number = np.searchsorted(open_, doc[own])
        share, likely = shares(p[own], n[own], number, len(open_), allowed)
        likely = likely - (k - 1) * cost[open_]
        better = likely > value[open_]
        chosen[open_[better]], value[open_[better]] = share[better], likely[better]
        k += 1
        # a larger set can't be better than the mixture of all languages
        open_ = open_[(best_of_all - (k - 1) * cost)[open_] > value[open_]] if k <= p.shape[1] else open_[:0]
    return chosen, every


def fit(docs: DataFrame, learned_from: Column) -> Model:
    """The models of the languages of docs (doc_id, text, lang) where learned_from holds and neither text nor lang is null."""
    small_batches(docs.sparkSession)
    rows = docs.where(learned_from & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    table = counts(rows).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    counted, place = np.zeros((len(langs), 1 << BITS), np.int64), {x: i for i, x in enumerate(langs)}
    for lang, slab, x in zip(table["lang"].to_pylist(), table["slab"].to_pylist(), table["counts"].to_pylist()):
        counted[place[lang], slab * SLAB : (slab + 1) * SLAB] = np.frombuffer(x, np.int64)
    return Model(langs, counted)


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, languages (of the chosen set, by share), proportions. The model is broadcast: 0.5 MB a language."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in text_batches(batches):
            m, block = shared.value, Block(b.column(1))
            names, score = np.full(block.n, UNKNOWN, object), np.zeros(block.n)
            sets, parts = [[] for _ in range(block.n)], [[] for _ in range(block.n)]
            doc, bucket, n = grams(block) if len(block.data) and m.langs else (np.zeros(0, int),) * 3
            own, number = np.unique(doc, return_inverse=True)
            if len(own):
                chosen, every = mixtures(m.p[bucket], n.astype(float), number, len(own), penalty)
                rounded = np.round(chosen, 9)
                top = rounded.argmax(1)
                names[own] = np.array(m.langs, object)[top]
                score[own] = np.clip(every[np.arange(len(own)), top], 0, 1)
                for i, d in enumerate(own.tolist()):
                    some = [j for j in np.argsort(-rounded[i], kind="stable").tolist() if rounded[i, j] > 0]
                    sets[d], parts[d] = [m.langs[j] for j in some], rounded[i, some].tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "languages", "proportions"])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, languages array<string>, proportions array<double>")
