"""Vectorised views of a batch of texts.

A ``Block`` is one Arrow batch of texts as one UTF-8 byte array with offsets. Words,
pre-tokens, hashes and windows are computed for the whole batch by numpy, so that a task
never loops over characters in Python. A block holds one batch only: memory is bounded by
the batch's bytes, whatever the size of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Spans of more bytes are hashed one by one.
LONG = 64
TAIL = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], U64)

#: Words of the contracts: runs of anything but blank, tab and the four line characters.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of ASCII letters, digits and anything beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of h over all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    return mix(mix(a + U64(0x9E3779B97F4A7C15)) ^ b)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: eight bytes at a time go through mix(), so no sum of bytes or powers cancels out. The same bytes have the same hash in every block."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, U64, padded, strides=(1,))  # the eight bytes from each place
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15))
    own, nth = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(own):
        part = eight[starts[own] + nth] & TAIL[np.minimum(size[own] - nth, 8)]
        h[own] = both(h[own], part)
        nth += 8
        own = own[size[own] > nth]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h


def same_bytes(data: np.ndarray, starts: np.ndarray, other: np.ndarray, other_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size[i] bytes from starts[i] in data are those from other_starts[i] in other."""
    out = np.ones(len(starts), bool)
    some = np.flatnonzero(size > 0)
    if len(some):
        n = size[some]
        differ = data[ranges(starts[some], n)] != other[ranges(other_starts[some], n)]
        out[some] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return out


def text_batches(batches, most_bytes: int = 2_000_000):
    """Slices of Arrow record batches that hold about most_bytes of their column text at most; a row is never cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.diff(offsets_of(batch.column(batch.schema.get_field_index("text"))))
        step, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = step[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(step, base + most_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def offsets_of(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ...: the flat indices of ragged slices."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, code point) of each character of UTF-8 bytes."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.int32)
    point, wide = first.copy(), np.flatnonzero(first >= 0xC0)
    if len(wide):
        at, f = lead[wide], first[wide]
        b = [data[np.minimum(at + i, len(data) - 1)].astype(np.int32) & 0x3F for i in range(4)]
        two, three = (f & 0x1F) << 6 | b[1], (f & 0x0F) << 12 | b[1] << 6 | b[2]
        point[wide] = np.where(f < 0xE0, two, np.where(f < 0xF0, three, (f & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
    return lead, point


class Block:
    """texts: an Arrow string or binary column; nulls count as empty."""

    def __init__(self, texts: pa.Array):
        off = offsets_of(texts) if len(texts) else np.zeros(1, np.int32)
        data = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[off[0] : off[-1]]
        self.off = (off - off[0]).astype(np.int64)
        self.n = len(texts)

    def doc_flags(self) -> np.ndarray:
        """True at the first byte of every text that isn't empty."""
        flags = np.zeros(len(self.data) + 1, bool)
        flags[self.off[:-1]] = True
        return flags[: len(self.data)]

    def words(self, table: np.ndarray) -> "Spans":
        """Runs of bytes that table marks; never over the end of a text."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return Spans(self, none, none)
        inside = table[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first |= inside & self.doc_flags()
        starts = np.flatnonzero(first)
        # a word ends where the next byte is outside, or where another text begins
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        return Spans(self, starts, np.flatnonzero(last) + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        return span_hashes(LOWER[self.data] if lower else self.data, starts, ends)


class Spans:
    """Byte spans in a block in order of their text; first[d]: number of the first span of text d."""

    def __init__(self, block: Block, starts: np.ndarray, ends: np.ndarray):
        self.block, self.starts, self.ends = block, starts, ends
        self.first = np.searchsorted(starts, block.off)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.block.n), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.block.hashes(self.starts, self.ends, lower)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the spans at which a window of k spans of one text starts, hash of each window's spans)."""
        counts = np.maximum(self.counts - (k - 1), 0)
        at = ranges(self.first[:-1], counts)
        return at, window_hashes(hashes, at, k)


def window_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each position in at: those of 1, 2, 4, ... hashes from every place, put together in order."""
    if not len(at):
        return np.zeros(0, U64)
    out, used, step, h = np.zeros(len(at), U64), 0, 1, hashes
    while True:
        if k & step:
            out, used = both(out, h[at + used]), used + step
        if used == k:
            return out
        h, step = both(h[:-step], h[step:]), 2 * step


def dictionary(spans: Spans, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each span's distinct bytes, bytes of the distinct ones end to end, offsets of these). Bytes are compared, not hashes."""
    size = spans.ends - spans.starts
    off = np.concatenate([[0], np.cumsum(size)])
    data = LOWER[spans.block.data] if lower else spans.block.data
    if off[-1] != len(data):
        data = data[ranges(spans.starts, size)]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(spans), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    words = Block(coded.dictionary)
    return coded.indices.to_numpy(), words.data, words.off
