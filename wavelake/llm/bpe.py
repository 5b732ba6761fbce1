"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary (levels of bit arrays, each keeping
the keys that have a position of their own; a key's number is the rank of its bit) finds
pre-tokens that are entries themselves; their bytes are compared. What it misses is merged:
short ones many at once, each losing a pair in each step, others by a heap of candidate pairs
over the linked bytes of the pre-token; lowest rank first, leftmost among equals. A worker
remembers the results by the pre-token's bytes.

Nulls and empty texts have no ids. Repeated rows are encoded each. Only doc_id and text are
read, so further columns of any name don't matter. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import U64, Block, mix, ranges, same_bytes, span_hashes, text_batches
from .common import id_and_text, small_batches
from .pretokens import Memory, encoded, pieces, pretokens

#: Bytes of pre-tokens that are merged at once at most, and as few of them as are merged one by one.
WIDTHS, FEW = (8, 12, 16, 32), 32

_built: dict = {}


class PerfectHash:
    """Numbers 0 .. n - 1 for n distinct 64-bit keys."""

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = keys, 0
        while len(left):
            size = max(64, int(room * len(left)))
            at = self._at(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = base + np.cumsum(alone) - alone
            self.levels.append((size, alone, rank))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.n = base

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64(0xD1B54A32D192ED03 * (level + 1) % 2**64)) % U64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; some number or -1 for keys that weren't given."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._at(keys[open_], level, size)
            hit = alone[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token. end[i] is the end of the part that starts at i; a heap entry (rank, i, e) proposes the part from i to e."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != e:
            continue
        end[i], alive[j], before[e] = e, False, i
        if e < n and (r := ranks.get(word[i : end[e]])) is not None:
            heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Merges many short pre-tokens at once: in each step every one of them loses its pair of lowest rank, the leftmost among equals."""

    NONE = 1 << 30

    def __init__(self, ranks: dict[bytes, int]):
        split = sorted((a, b, r) for w, r in ranks.items() for i in range(1, len(w)) if (a := ranks.get(w[:i])) is not None and (b := ranks.get(w[i:])) is not None)
        a, b, self.ranks = np.array(split, np.int64).reshape(-1, 3).T
        self.size = max(ranks.values(), default=0) + 1
        self.keys = a * self.size + b
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.double = np.full(1 << 16, self.NONE, np.int64)
        for w, r in ranks.items():
            if len(w) == 2:
                self.double[w[0] << 8 | w[1]] = r

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of what two ids (right: or -1) are together, or NONE."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((right >= 0) & (self.keys[at] == key), self.ranks[at], self.NONE)

    def __call__(self, words: list[bytes], width: int) -> list[list[int]]:
        """The ids of each word of 1 to width bytes."""
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))[:, None]
        column = np.arange(width)
        part = np.full((len(words), width + 1), -1, np.int64)
        part[:, :-1] = np.where(column < size, self.single[raw], -1)
        rank = np.full((len(words), width), self.NONE, np.int64)
        rank[:, :-1] = np.where(column[1:] < size, self.double[raw[:, :-1] << 8 | raw[:, 1:]], self.NONE)
        out, at = np.empty((len(words), width), np.int64), np.arange(len(words))
        while len(at):
            j = rank.argmin(1)
            best = rank[np.arange(len(at)), j]
            if (done := best == self.NONE).any():
                out[at[done]] = part[done, :-1]
                at, part, rank, j, best = at[~done], part[~done], rank[~done], j[~done], best[~done]
            nth, right = np.arange(len(at)), column >= j[:, None] + 1
            part[:, :-1] = np.where(right, part[:, 1:], part[:, :-1])
            rank[:, :-1] = np.where(right[:, :-1], rank[:, 1:], rank[:, :-1])
            part[nth, j] = best
            rank[nth, j] = self.rank(best, part[nth, j + 1])
            some = np.flatnonzero(j > 0)
            rank[some, j[some] - 1] = self.rank(part[some, j[some] - 1], best[some])
        flat, ends = out[out >= 0].tolist(), np.cumsum((out >= 0).sum(1)).tolist()
        return [flat[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


class Vocabulary:
    """raw: the rank file, a base64 token and its rank in each line."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        block = Block(pa.array(list(self.ranks), pa.binary()))
        keys, ids = span_hashes(block.data, block.off[:-1], block.off[1:]), np.array(list(self.ranks.values()), np.int64)
        self.hash = PerfectHash(keys)
        self.ids = np.empty(len(ids), np.int64)
        self.ids[self.hash(keys)] = ids
        # for decoding: all tokens by id, end to end
        by_id = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            by_id[i] = token
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in by_id])]).astype(np.int64)
        self.memory = Memory()
        self.pairs = Pairs(self.ranks)
        self.whole = bool(len(self.pairs.keys)) and (self.pairs.single >= 0).all()

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of the pre-tokens, short ones at once."""
        out: list = [None] * len(words)
        of: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            of.setdefault(next((x for x in WIDTHS if len(w) <= x), 0), []).append(i)
        for width, own in of.items():
            some = [words[i] for i in own]
            for i, ids in zip(own, self.pairs(some, width) if width and len(own) >= FEW and self.whole else [merged(w, self.ranks) for w in some], strict=True):
                out[i] = ids
        return out

    def distinct(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of pre-tokens that lie end to end."""
        size, n = np.diff(off), len(off) - 1
        at = self.hash(span_hashes(data, off[:-1], off[1:]))
        entry = np.where(at >= 0, self.ids[at] if len(self.ids) else -1, -1)
        own = np.flatnonzero(entry >= 0)
        own = own[self.ends[entry[own] + 1] - self.ends[entry[own]] == size[own]]
        own = own[same_bytes(data, off[own], self.bytes, self.ends[entry[own]], size[own])]
        whole = np.zeros(n, bool)
        whole[own] = True
        rest = np.flatnonzero(~whole)
        counts = np.ones(n, np.int64)
        some, counts[rest] = self.memory.lists(pieces(data, off, rest), self.merged)
        begin = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.uint32)
        ids[begin[own]] = entry[own]
        ids[ranges(begin[rest], counts[rest])] = some
        return ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        return encoded(pretokens(texts), self.distinct)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, number of bytes of each id)."""
        begin = self.ends[ids]
        sizes = self.ends[ids.astype(np.int64) + 1] - begin
        return self.bytes[ranges(begin, sizes)], sizes


def built(path: str, raw) -> Vocabulary:
    """The vocabulary, made once in each Python worker."""
    if path not in _built:
        _built[path] = Vocabulary(raw.value)
    return _built[path]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow binary column of consecutive slices of data."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _given(docs: DataFrame, vocabulary: str):
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:  # the vocabulary's file, not data: its size is fixed
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids: the ids of each text as little-endian unsigned 32-bit integers. vocabulary: path of a rank file."""
    raw = _given(docs, vocabulary)

    def run(batches):
        v = built(vocabulary, raw)
        for b in text_batches(batches):
            ids, counts = v.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), binary(ids.astype("<u4").view(np.uint8), 4 * np.cumsum(counts))], ["doc_id", "n_tokens", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return id_and_text(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """coded (doc_id, n_tokens, ids) with decoded: the bytes that the ids stand for."""
    raw = _given(coded, vocabulary)

    def run(batches):
        v = built(vocabulary, raw)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own = b.slice(at, 256)
                blobs = own.column(2)
                off = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
                data = blobs.buffers()[2]
                ids = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view("<u4") if data is not None and off[-1] > off[0] else np.zeros(0, "<u4")
                out, sizes = v.decode(ids)
                upto = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([*own.columns, binary(out, upto[(off[1:] - off[0]) // 4])], [*own.schema.names, "decoded"])

    kind = dict(coded.dtypes)["doc_id"]
    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """What decode(encode(docs)) gives, in one pass of one Python worker a task."""
    raw = _given(docs, vocabulary)

    def run(batches):
        v = built(vocabulary, raw)
        for b in text_batches(batches):
            ids, counts = v.encode(b.column(1))
            out, sizes = v.decode(ids)
            ends = np.cumsum(counts)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), binary(ids.astype("<u4").view(np.uint8), 4 * ends), binary(out, upto[ends])], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return id_and_text(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
