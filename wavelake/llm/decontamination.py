"""Benchmark decontamination by a broadcast hash set of test n-grams.

Windows of 13 normalised words of each benchmark item (an item of fewer words is one window)
are broadcast as a sorted hash set and scanned for in the words of every document; what the
hashes hit is verified word by word. Beyond MOST_WINDOWS windows or MOST_BYTES of their words the
set is a bitmap of BITS hashes, and what hits it is joined to the windows by the words; documents
are scanned once in either case, and the results are the same.

Item ids are not broadcast: a window carries a hash of the set of items that have it (its owners), and
the sets are joined to what was found, once for each different list of them. A window of very many items
so costs no more than another; its ids meet in one row, as they do in the result.

Words: A-Z lower-cased; runs of ASCII letters, digits and anything beyond ASCII. A null or
empty text has no words and no hits; a null item has no windows, an item without item_id is
left out. Repeated rows are judged each. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ALNUM_WORDS, LOWER, Block, ranges, text_batches, window_hashes
from .common import bit_set, id_and_text, small_batches, written

K = 13
#: Windows in one broadcast, and bytes of their words.
MOST_WINDOWS, MOST_BYTES = 500_000, 64 << 20
#: Bits of the hash set of a larger benchmark: 16 MB.
BITS = 1 << 27
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_built: dict = {}


def windows(benchmark: DataFrame, k: int = K) -> DataFrame:
    """words (the k words of a window, one blank between), items (sorted ids of the items that have it), owners (a hash of items)."""
    words = F.regexp_extract_all(F.translate("text", UPPER, SMALL), F.lit(WORD), F.lit(0))
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where("size(w) > 0")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " "))
    return rows.select("item", F.explode(each).alias("words")).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("owners", F.sha2(F.to_json("items"), 256))


class Index:
    """Windows by length, to be found in blocks of texts."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.owners = [owners for _, owners in rows]
        block = Block(pa.array([w for w, _ in rows], pa.large_string()))
        spans = block.words(ALNUM_WORDS)
        hashes, sizes = spans.hashes(True), spans.ends - spans.starts
        self.by_length = []
        for k in np.unique(spans.counts).tolist():
            own = np.flatnonzero(spans.counts == k)
            first = spans.first[own]
            h = window_hashes(hashes, first, k)
            order = np.argsort(h, kind="stable")
            own, first, h = own[order], first[order], h[order]
            words = sizes[first[:, None] + np.arange(k)]
            at = ranges(spans.starts[(first[:, None] + np.arange(k)).ravel()], words.ravel())
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            total = words.sum(1)
            self.by_length.append((k, h, own, words, block.data[at], np.cumsum(total) - total, bits))

    def hits(self, spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the first word, number of words, number of the window) of each occurrence."""
        out = [(np.zeros(0, np.int64),) * 3]
        if not len(spans):
            return out[0]
        hashes, sizes, data = spans.hashes(True), spans.ends - spans.starts, LOWER[spans.block.data]
        for k, h, own, words, raw, begin, bits in self.by_length:
            at, found = spans.windows(hashes, k)
            maybe = bits[(found >> np.uint64(44)).astype(np.int64)]
            at, found = at[maybe], found[maybe]
            left, right = np.searchsorted(h, found), np.searchsorted(h, found, "right")
            entry, at = ranges(left, right - left), np.repeat(at, right - left)
            if not len(at):
                continue
            mine = sizes[at[:, None] + np.arange(k)]
            same = (mine == words[entry]).all(1)
            at, entry, mine = at[same], entry[same], mine[same]
            if not len(at):
                continue
            total = mine.sum(1)
            a = data[ranges(spans.starts[(at[:, None] + np.arange(k)).ravel()], mine.ravel())]
            b = raw[ranges(begin[entry], total)]
            same = np.add.reduceat(a != b, np.cumsum(total) - total) == 0
            out.append((at[same], np.full(int(same.sum()), k), own[entry[same]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def covered(n: int, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of n words any of the spans covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts, -1)
    return np.cumsum(edge[:-1]) > 0


def scan(docs: DataFrame, rows) -> DataFrame:
    """doc_id, n_words, hits (first word and number of words of each run of hit words), owners (those of the windows that occur), for a broadcast of windows."""

    mark = uuid.uuid4().hex

    def run(batches):
        if mark not in _built:
            _built.clear()
            _built[mark] = Index(rows.value)
        index = _built[mark]
        for b in text_batches(batches):
            spans = Block(b.column(1)).words(ALNUM_WORDS)
            at, k, entry = index.hits(spans)
            hits: list[list] = [[] for _ in range(b.num_rows)]
            owners: list[set] = [set() for _ in range(b.num_rows)]
            if len(at):
                doc = np.searchsorted(spans.first, at, "right") - 1
                for d, e in np.unique(np.stack([doc, entry], 1), axis=0).tolist():
                    owners[d].add(index.owners[e])
                hit = np.concatenate([covered(len(spans), at, k), [False]])
                edge = np.diff(np.concatenate([[False], hit]).astype(np.int8))
                edge[spans.first[:-1]] = np.where(hit[spans.first[:-1]], 1, edge[spans.first[:-1]])  # runs end with their text
                starts = np.flatnonzero((edge == 1) & hit)
                stops = np.flatnonzero(~hit)
                ends = np.minimum(stops[np.searchsorted(stops, starts)], spans.first[np.searchsorted(spans.first, starts, "right")])
                own = np.searchsorted(spans.first, starts, "right") - 1
                for d, s, n in zip(own.tolist(), (starts - spans.first[own]).tolist(), (ends - starts).tolist(), strict=True):
                    hits[d].append({"word": s, "n": n})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(spans.counts), pa.array(hits, pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))), pa.array([sorted(x) for x in owners], pa.list_(pa.string()))],
                ["doc_id", "n_words", "hits", "owners"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, hits array<struct<word:long,n:long>>, owners array<string>")


def candidates(docs: DataFrame, bitmap, lengths: list[int]) -> DataFrame:
    """doc_id, n_words, found (first word, number of words, the words) of each window of a document whose hash has its bit in the broadcast bitmap."""
    kinds = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64()), ("words", pa.string())]))

    def run(batches):
        bits = bitmap.value
        for b in text_batches(batches):
            block = Block(b.column(1))
            spans = block.words(ALNUM_WORDS)
            found: list[list] = [[] for _ in range(b.num_rows)]
            if len(spans):
                hashes, raw = spans.hashes(True), LOWER[block.data].tobytes()
                for k in lengths:
                    at, h = spans.windows(hashes, k)
                    h = (h & np.uint64(BITS - 1)).astype(np.int64)
                    at = at[bits[h >> 3] >> (h & 7).astype(np.uint8) & 1 == 1]
                    for d, i in zip((np.searchsorted(spans.first, at, "right") - 1).tolist(), at.tolist(), strict=True):
                        words = b" ".join(raw[x:y] for x, y in zip(spans.starts[i : i + k].tolist(), spans.ends[i : i + k].tolist(), strict=True))
                        found[d].append({"word": i - int(spans.first[d]), "n": k, "words": words.decode()})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans.counts), pa.array(found, kinds)], ["doc_id", "n_words", "found"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, found array<struct<word:long,n:long,words:string>>")


def window_bits(grams: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(a bitmap of BITS hashes of windows, the numbers of words that windows have): of fixed size, whatever the benchmark's."""

    def run(batches):
        for b in text_batches(batches):
            spans = Block(b.column(0)).words(ALNUM_WORDS)
            hashes, h = spans.hashes(True), np.zeros(b.num_rows, np.uint64)
            for k in np.unique(spans.counts).tolist():
                own = np.flatnonzero(spans.counts == k)
                h[own] = window_hashes(hashes, spans.first[own], k)
            yield pa.RecordBatch.from_arrays([pa.array((h & np.uint64(BITS - 1)).astype(np.int64)), pa.array(spans.counts)], ["bit", "n"])

    hashed = grams.select(F.col("words").alias("text")).mapInArrow(run, "bit long, n long")
    lengths = sorted(r.n for r in hashed.select("n").distinct().collect())  # k at most
    return bit_set(hashed, BITS), lengths


def with_items(found: DataFrame, grams: DataFrame) -> DataFrame:
    """found with the items of all its owners (sorted, each once); those of each different list of owners are put together once."""
    some = found.where("size(owners) > 0").withColumn("list", F.sha2(F.to_json("owners"), 256))
    lists = some.select("list", "owners").dropDuplicates(["list"]).select("list", F.explode("owners").alias("owners"))
    each = lists.join(grams.select("owners", "items").dropDuplicates(["owners"]), "owners").select("list", F.explode("items").alias("item")).distinct()
    named = some.join(each.groupBy("list").agg(F.array_sort(F.collect_list("item")).alias("items")), "list").drop("list", "owners")
    return found.where("size(owners) = 0").drop("owners").withColumn("items", F.array().cast("array<string>")).unionByName(named)


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = K, most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, hits, n_hit, items (sorted as strings), contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs, grams = id_and_text(docs), written(windows(benchmark, k), "windows")
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= most_windows and size["bytes"] <= most_bytes:
        once: dict[str, str] = {}  # equal owners are one string of the broadcast
        rows = [(r.words, once.setdefault(r.owners, r.owners)) for r in grams.select("words", "owners").collect()]  # bounded just above
        found = written(scan(docs, spark.sparkContext.broadcast(rows)), "found")
    else:
        bits, lengths = window_bits(grams)
        maybe = written(candidates(docs, spark.sparkContext.broadcast(bits), lengths).withColumn("row", F.monotonically_increasing_id()), "candidates")
        # the words themselves are compared by the join
        hits = written(maybe.select("row", F.inline("found")).join(grams.select("words", "owners"), "words").select("row", "owners", F.sequence("word", F.col("word") + F.col("n") - 1).alias("at")), "occurrences")
        words = hits.select("row", F.explode("at").alias("word")).distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("word", F.lit(1).cast("long").alias("n")))).alias("hits"))
        owners = hits.groupBy("row").agg(F.array_sort(F.collect_set("owners")).alias("owners"))
        found = maybe.join(words, "row", "left").join(owners, "row", "left").select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<struct<word:bigint,n:bigint>>")).alias("hits"), F.coalesce("owners", F.array().cast("array<string>")).alias("owners"))
        found = written(found, "found")
    out = with_items(found, grams)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["n"])
    out = out.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, k: int = K, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated."""
    key = lambda: F.struct("doc_id", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("text")).alias("key")
    bad = contamination(docs.select(key(), "text").withColumnRenamed("key", "doc_id"), benchmark, k, most_windows).where("contaminated")
    # the table's own columns stay in a struct, so that none clashes
    rows, bad = docs.select(key(), F.struct("*").alias("row")), bad.select(F.col("doc_id").alias("key")).distinct()
    same = F.col("rows.key.doc_id").eqNullSafe(F.col("bad.key.doc_id")) & (F.col("rows.key.text") == F.col("bad.key.text"))
    return rows.alias("rows").join(bad.alias("bad"), same, "left_anti").select("row.*")
