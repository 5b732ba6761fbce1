"""The byte-level pre-tokeniser as array operations.

It cuts texts where the pattern of the public byte-level vocabularies does (contractions; a
run of letters, of digits or of other signs, each with one blank before it; white space),
for a whole batch at once: runs of one character class, then the corrections at white space
and apostrophes.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .blocks import Block, Spans, code_points, dictionary, ranges

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Characters with the property White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What follows an apostrophe in a contraction.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, (x for x in range(sys.maxunicode + 1) if not 0xD800 <= x < 0xE000)))
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            out[a:b] = kind
    out[list(WHITE)] = SPACE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    lead, point = code_points(data)
    kind = classes().take(np.minimum(point, sys.maxunicode))
    return np.repeat(kind, np.diff(np.append(lead, len(data))))


def pretokens(texts: pa.Array) -> Spans:
    """The pre-tokens of each text, which together are all its bytes."""
    block = Block(texts)
    data, n = block.data, len(block.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Spans(block, none, none)
    kind, doc = byte_classes(data), block.doc_flags()
    start = doc.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # white space before something else: its last character stands alone, or goes to what follows if it is a blank
    after = np.flatnonzero(start & ~doc & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    blank = data[after - 1] == 0x20
    last = after - 1
    for _ in range(3):  # the first byte of that last character
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[after[blank]] = False
    # contractions: an apostrophe alone between something that isn't a blank, and letters
    mark = np.flatnonzero((data == 0x27) & start)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~doc[mark + 1]]
    for tail in CONTRACTIONS:
        fits, end = mark + len(tail) < n, mark + len(tail) + 1
        for i, x in enumerate(tail):
            at = np.minimum(mark + 1 + i, n - 1)
            fits = fits & (data[at] == x) & ~doc[at]
        own, end = mark[fits], end[fits]
        start[own + 1] = False
        rest = end[end < n]
        start[rest] = True
        mark = mark[~fits]
    starts = np.flatnonzero(start)
    return Spans(block, starts, np.append(starts[1:], n))


class Memory:
    """Lists of integers by bytes. It forgets all when it would hold more than most keys."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.values, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, or -1."""
        get = self.slots.get
        return np.fromiter((get(x, -1) for x in keys), np.int64, len(keys))

    def add(self, keys: list[bytes], lists: list) -> None:
        n = len(self.slots)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        used, total = self.ends[n], int(sizes.sum())
        while used + total > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while n + len(keys) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[used : used + total] = np.fromiter((x for v in lists for x in v), np.uint32, total)
        self.ends[n + 1 : n + 1 + len(keys)] = used + np.cumsum(sizes)
        self.slots.update(zip(keys, range(n, n + len(keys)), strict=True))

    def lists(self, keys: list[bytes], make) -> tuple[np.ndarray, np.ndarray]:
        """(values of the lists of distinct keys, end to end; the size of each list). make(keys) gives the lists that the memory lacks."""
        slots = self.find(keys)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            if len(self.slots) + len(missing) > self.most:
                self.forget()
                missing = np.arange(len(keys))
            new = [keys[i] for i in missing.tolist()]
            self.add(new, make(new))
            slots = self.find(keys)
        begin = self.ends[slots]
        counts = self.ends[slots + 1] - begin
        return self.values.take(ranges(begin, counts), mode="clip"), counts


def spread(codes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all spans, number of ids of each), from those of each distinct span."""
    begin = np.cumsum(counts) - counts
    own = counts.take(codes, mode="clip")
    return ids.take(ranges(begin.take(codes, mode="clip"), own), mode="clip"), own


def per_text(spans: Spans, counts: np.ndarray) -> np.ndarray:
    """Sums over the spans of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(counts)])[spans.first])


def encoded(spans: Spans, encode) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pre-tokens in order, number of ids of each text). encode(bytes end to end, offsets) gives (ids, number of ids) of the batch's distinct pre-tokens."""
    if not len(spans):
        return np.zeros(0, np.uint32), np.zeros(spans.block.n, np.int64)
    codes, data, off = dictionary(spans)
    ids, counts = spread(codes, *encode(data, off))
    return ids, per_text(spans, counts)


def pieces(data: np.ndarray, off: np.ndarray, which=None) -> list[bytes]:
    """The bytes of each span, or of those that which numbers."""
    raw = data.tobytes()
    a, z = (off[:-1], off[1:]) if which is None else (off[which], off[which + 1])
    return [raw[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]
