"""Substring deduplication with automata of repeated phrases.

A window is K consecutive words. A word is removed if a window that covers it also starts in a
document with a smaller doc_id. Nothing is sampled or capped; the result is exact.

1. Anchors. A window's anchor is the least hash of its 8-word phrases; equal windows have equal
   anchors, and neighbouring windows mostly share one, so a text has one for every 22 words or
   so. Only anchors that different texts have can be those of repeated windows.
2. Confirm. Documents with such anchors (suspects) give the hashes of their windows there; a
   hash with more than one document is a repeated window, and the least document owns it.
3. Automata. In the owner's text, neighbouring owned windows of one anchor make a pattern: the
   words common to them (its phrase) and the words to both sides. Suspects are dealt into parts
   by doc_id, as many as keep a part's patterns at PART_PATTERNS; a part gets the patterns of its
   documents' anchors, compiles the phrases into an
   Aho-Corasick automaton over word numbers, and streams its documents through it. A hit is
   extended into the pattern's sides word by word; K equal words or more are an occurrence.

A passage that very many documents share is one pattern, sent once to each part; its documents
are spread by doc_id. Copies of a text need none of this: all but the least doc_id lose all
their words, if these are K or more. Texts pass a shuffle once, suspects' twice more. Window
and anchor hashes have 64 bits and only choose what is compared word by word.

Null texts have no words; texts of fewer than K words lose none. Rows without doc_id neither
lose words nor cost others any. Repeated rows are judged each, and not against each other.
Only doc_id and text are read. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE_WORDS, Block, ranges, text_batches, window_hashes
from .common import id_and_text, small_batches, written
from .decontamination import covered

K, PHRASE = 50, 8
#: Patterns in the automaton of one part: about 1.5 MB for each 1000.
PART_PATTERNS = 20_000
MARKS = "array<struct<word:long,n:long>>"
MARK = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))


def anchors(texts: pa.Array, k: int = K, phrase: int = PHRASE):
    """(words, hashes of the words, number of the first word of each window, anchor of each window) of a batch."""
    spans = Block(texts).words(SPACE_WORDS)
    hashes = spans.hashes()
    at = ranges(spans.first[:-1], np.maximum(spans.counts - (k - 1), 0))
    if not len(at):
        return spans, hashes, at, np.zeros(0, np.int64)
    least = window_hashes(hashes, np.arange(len(hashes) - phrase + 1), phrase).view(np.int64)
    width, span = k - phrase + 1, 1
    while 2 * span <= width:  # the least of span phrases from each place, then of twice as many
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return spans, hashes, at, least[at]


def _runs(at: np.ndarray, anchor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, one past the last) index of each run of consecutive windows of one anchor, cut at most windows."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0)])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    pieces = -(-size // most)
    first = np.repeat(start, pieces) + most * ranges(np.zeros_like(pieces), pieces)
    return first, np.minimum(first + most, np.repeat(start + size, pieces))


def hash_of(raw: bytes) -> int:
    """What xxhash64() of a column gives."""
    h = xxhash.xxh64_intdigest(raw, seed=42)
    return h - (1 << 64) if h >> 63 else h


def text_anchors(docs: DataFrame, k: int) -> DataFrame:
    """text_hash, anchor of each text."""

    def run(batches):
        for b in text_batches(batches):
            spans, _, at, anchor = anchors(b.column(0), k)
            first, _ = _runs(at, anchor, 1 << 40)
            key = b.column(1).to_numpy()[spans.docs()[at[first]]]
            pairs = np.unique(np.stack([key, anchor[first]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["text_hash", "anchor"])

    return docs.select("text", "text_hash").mapInArrow(run, "text_hash long, anchor long")


def judged_early(docs: DataFrame, k: int, value) -> DataFrame:
    """docs (doc_id, text, copy, anchors): the results of copies and of texts without repeated anchors; the others keep text and anchors."""

    def run(batches):
        for b in text_batches(batches):
            out: dict[str, list] = {x: [] for x in ("doc_id", "text_hash", "n_words", "removed", "value", "text", "anchors")}
            for doc_id, text, copy, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if not own else b""
                words = raw.split()
                removed = bool(copy) and len(words) >= k
                row = (doc_id, None, None, None, None, text.as_py(), own) if own else (doc_id, hash_of(raw), len(words), [{"word": 0, "n": len(words)}] if removed else [], value(b"" if removed else b" ".join(words)), None, None)
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["text_hash"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["removed"], MARK), pa.array(out["value"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["anchors"], pa.list_(pa.int64()))], list(out))

    return docs.mapInArrow(run, f"doc_id long, text_hash long, n_words long, removed {MARKS}, value string, text string, anchors array<long>")


def _chosen(docs: np.ndarray, values: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether values[i] is in the list of row docs[i]."""
    off = lists.offsets.to_numpy()
    owner, flat = np.repeat(np.arange(len(lists)), np.diff(off)), lists.values.to_numpy()[off[0] : off[-1]]
    pair = np.dtype([("d", np.int64), ("v", np.int64)])

    def pairs(d, v):
        out = np.empty(len(d), pair)
        out["d"], out["v"] = d, v
        return out

    return np.isin(pairs(docs, values).view("V16"), pairs(owner, flat).view("V16")) if len(flat) and len(values) else np.zeros(len(values), bool)


def suspect_windows(suspects: DataFrame, k: int) -> DataFrame:
    """hash, least and most doc_id of the windows at repeated anchors, put together for each batch."""

    def run(batches):
        for b in text_batches(batches):
            ids = b.column(0).to_numpy()
            spans, hashes, at, anchor = anchors(b.column(1), k)
            doc = spans.docs()[at]
            own = _chosen(doc, anchor, b.column(2))
            h, d = window_hashes(hashes, at[own], k).view(np.int64), ids[doc[own]]
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(h)) - 1 if len(h) else first
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(d[first]), pa.array(d[last])], ["hash", "least", "most"])

    return suspects.select("doc_id", "text", "anchors").mapInArrow(run, "hash long, least long, most long")


def owned_patterns(owners: DataFrame, k: int) -> DataFrame:
    """owners (doc_id, text, hashes of the windows that it owns): owner, anchor, left, phrase, right of each pattern, as words with one blank between."""

    def run(batches):
        for b in text_batches(batches):
            ids = b.column(0).to_pylist()
            spans, hashes, at, anchor = anchors(b.column(1), k)
            doc = spans.docs()[at]
            own = _chosen(doc, window_hashes(hashes, at, k).view(np.int64), b.column(2))
            at, anchor, doc = at[own], anchor[own], doc[own]
            first, end = _runs(at, anchor, k - PHRASE + 1)
            raw, s, e = spans.block.data.tobytes(), spans.starts, spans.ends
            words = lambda i, j: b" ".join(raw[s[x] : e[x]] for x in range(i, j)).decode()
            rows = [(ids[doc[f]], int(anchor[f]), words(a := at[f], z := at[l - 1]), words(z, a + k), words(a + k, z + k)) for f, l in zip(first, end, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["owner", "anchor", "left", "phrase", "right"])

    return owners.mapInArrow(run, "owner long, anchor long, left string, phrase string, right string")


class Automaton:
    """Patterns (owner, left, phrase, right) of one part, as tuples of word numbers from 1; 0 is any other word."""

    def __init__(self, k: int):
        self.k, self.numbers, self.patterns, self.ready = k, {}, {}, None

    def _numbered(self, words: str) -> tuple[int, ...]:
        numbers = self.numbers
        return tuple([numbers.setdefault(w, len(numbers) + 1) for w in words.split(" ")]) if words else ()

    def add(self, owner: int, left: str, phrase: str, right: str) -> None:
        self.patterns.setdefault(self._numbered(phrase), []).append((owner, self._numbered(left)[::-1], self._numbered(right)))

    def removed(self, doc_id: int, words: list[str]) -> np.ndarray:
        """Which of the words are covered by a window of a smaller doc_id."""
        import ahocorasick

        if self.ready is None:
            self.ready = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for phrase, known in self.patterns.items():
                self.ready.add_word(phrase, (len(phrase), known))
            self.ready.make_automaton()
        spans: set[tuple[int, int]] = set()
        if self.patterns and words:
            get = self.numbers.get
            hay = tuple([get(w, 0) for w in words])
            for last, (n, known) in self.ready.iter(hay):
                begin, end = last + 1 - n, last + 1
                for owner, left, right in known:
                    if owner < doc_id:
                        a, z = begin - self._same(hay[max(0, begin - len(left)) : begin][::-1], left), end + self._same(hay[end : end + len(right)], right)
                        if z - a >= self.k:
                            spans.add((a, z - a))
        at = np.array(sorted(spans), np.int64).reshape(-1, 2)
        return covered(len(words), at[:, 0], at[:, 1])

    @staticmethod
    def _same(a: tuple, b: tuple) -> int:
        """Length of the common beginning."""
        if a == b[: len(a)]:
            return len(a)
        return next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)


def streamed(rows: DataFrame, k: int, value) -> DataFrame:
    """rows (part, owner, left, phrase, right, doc_id, text), sorted by part with patterns first: the results of the documents."""
    kinds = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n_words": pa.int64(), "removed": MARK, "value": pa.string()}

    def run(batches):
        part, automaton = None, None
        for b in batches:
            small = [b.column(i).to_pylist() for i in range(6)]
            out: dict[str, list] = {x: [] for x in kinds}
            held = 0
            for i, (p, owner, left, phrase, right, doc_id) in enumerate(zip(*small, strict=True)):
                if p != part:
                    part, automaton = p, Automaton(k)
                if doc_id is None:
                    automaton.add(owner, left, phrase, right)
                    continue
                text = b.column(6)[i].as_py()  # one text at a time
                raw = text.encode()
                words = [w.decode() for w in raw.split()]
                gone = automaton.removed(doc_id, words)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))).reshape(-1, 2)
                row = (doc_id, hash_of(raw), len(words), [{"word": a, "n": z - a} for a, z in edge.tolist()], value(" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]).encode()))
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
                held += len(raw)
                if held > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in kinds.items()], list(kinds))
                    out, held = {x: [] for x in kinds}, 0
            yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in kinds.items()], list(kinds))

    return rows.mapInArrow(run, f"doc_id long, text_hash long, n_words long, removed {MARKS}, value string")


def parts_for(patterns: DataFrame, suspects: DataFrame, least: int) -> int:
    """Into how many parts the suspects go, so that a part gets PART_PATTERNS patterns on average at most: a pattern goes to every part that has a document with its anchor, that is to min(such documents, parts) of them."""
    docs = suspects.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("docs"))
    by_size = patterns.groupBy("anchor").agg(F.count("*").alias("patterns")).join(docs, "anchor").groupBy(F.floor(F.log2("docs")).cast("int").alias("level")).agg(F.sum("patterns").alias("n"), F.max("docs").alias("docs")).collect()  # a row for each power of two
    parts = least
    while sum(r["n"] * min(r["docs"], parts) for r in by_size) > parts * PART_PATTERNS:
        parts *= 2
    return parts


def deduplicated(docs: DataFrame, value=bytes.decode, k: int = K) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_words, removed (first word and number of words of each removed run), value: what value(bytes) gives, as a string, for the kept words joined by one blank; by default these words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = rows.where("doc_id is not null")
    # 1. anchors that different texts have, by the least document of each text
    found = written(text_anchors(known.select("text", F.xxhash64("text").alias("text_hash")), k), "anchors")
    repeated = found.groupBy("anchor").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("anchor")
    own = found.join(repeated, "anchor").groupBy("text_hash").agg(F.collect_set("anchor").alias("anchors"))
    key = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    # the least document of each text; all others with the text are copies
    first = known.groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.first(F.xxhash64("text")).alias("text_hash")).join(own, "text_hash", "left").select("doc_id", "key", "anchors", F.lit(False).alias("copy"))
    early = known.withColumn("key", key).join(first, ["doc_id", "key"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(True)).alias("copy"), "anchors")
    early = early.unionByName(rows.where("doc_id is null").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<long>").alias("anchors")))
    early = written(judged_early(early, k, value), "judged")
    suspects = early.where("anchors is not null").select("doc_id", "text", "anchors")
    # 2. repeated windows and their owners
    windows = suspect_windows(suspects, k).groupBy("hash").agg(F.min("least").alias("owner"), F.max("most").alias("most")).where("owner < most")
    owned = windows.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("hash").alias("hashes"))
    patterns = written(owned_patterns(suspects.join(owned, "doc_id").select("doc_id", "text", "hashes"), k), "patterns")
    # 3. patterns go where documents with their anchor are
    parts = parts_for(patterns, suspects, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")
    needed = suspects.select(part, F.explode("anchors").alias("anchor")).distinct()
    sent = patterns.join(needed, "anchor").select("part", "owner", "left", "phrase", "right", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("owner", "long"), ("left", "string"), ("phrase", "string"), ("right", "string"))]
    both = sent.unionByName(suspects.select(part, *none, "doc_id", "text"))
    both = both.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").isNotNull(), "doc_id")
    return early.where("anchors is null").select("doc_id", "text_hash", "n_words", "removed", "value").unionByName(streamed(both, k, value))


def rewritten(docs: DataFrame, k: int = K) -> DataFrame:
    """docs with the kept words, one blank between, as the text of each row that loses words (and their number of characters as n_chars, if docs has it); other rows are as they were."""
    found = deduplicated(docs, k=k).where(F.size("removed") > 0)
    # the table's own columns stay in a struct, so that none clashes
    changed = found.select(F.struct("doc_id", "text_hash").alias("key"), F.col("value").alias("kept")).dropDuplicates(["key"])
    row = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).alias("key"), F.struct("*").alias("row"))
    out = row.join(changed, "key", "left").withColumn("changed", F.col("kept").isNotNull())
    field = lambda c: F.col("row")[c]
    text = {"text": lambda c: F.when(F.col("changed"), F.col("kept")).otherwise(field(c)), "n_chars": lambda c: F.when(F.col("changed"), F.char_length("kept")).otherwise(field(c)).cast(docs.schema[c].dataType)}
    return out.select(*(text.get(c, field)(c).alias(c) for c in docs.columns))
