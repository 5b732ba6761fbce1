"""Token ids in length-delimited binary records, with a separate offset index.

A file is a run of frames: length of the payload (u64), masked CRC-32C of those eight bytes
(u32), payload, masked CRC-32C of the payload (u32), all little-endian. A payload is doc_id
(i64), bytes per id (u8: 2 or 4), then the ids. The masking is the usual one of such files:
rotate right by 15, add 0xA282EAD8. The index is a Parquet table with a row for each record
(path, record, doc_id, offset, n_bytes, n_tokens), so that a reader can fetch records in any
order: read_records() goes through whole files, fetch() and shuffled() by the index.

Files are in ascending order of doc_id, and the records within each too: texts are dealt out
by ranges of doc_id and sorted there. A task writes a file under a name of its own; the index
is committed by Spark and names the files that count, so lost executors and repeated tasks
leave no double records.

A null doc_id is stored as the least integer and comes first; a null or empty text has the
end id alone. Ids are those of the tokenizers library for the whole text, its added tokens
included. Rows with one doc_id are all kept, in order of their text. Other columns are
not read. An empty table gives no file and an empty index.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import text_batches
from .common import id_and_text, small_batches
from .pretokens import Memory, encoded, pieces, pretokens

NO_ID = -(1 << 63)
CHUNK = 256
#: Records that a reader by the index gives at a time, and files that it keeps open.
FETCHED, OPEN = 64, 32
INDEX = "path string, record long, doc_id long, offset long, n_bytes long, n_tokens long"
_built: dict = {}


def _step(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[state & np.uint32(255)] ^ (state >> np.uint32(8))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of CRC-32C for a byte, and the four that carry a state over CHUNK zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    over = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(CHUNK):
        over = _step(over, table)
    return table, over


TABLE, OVER = _tables()


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of each slice of data (not empty): all chunks of all slices advance together, then each slice's chunks are joined."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    chunks = -(-sizes // CHUNK)
    ends = np.cumsum(chunks)
    first = ends - chunks
    owner = np.repeat(np.arange(len(starts)), chunks)
    nth = np.arange(int(ends[-1])) - first[owner]
    short = CHUNK * chunks - sizes  # what the first chunk of a slice lacks, at its front
    state = np.zeros(len(owner), np.uint32)
    at = starts[owner] + CHUNK * nth - short[owner]
    front = nth == 0
    lack = np.where(front, short[owner], 0)
    for i in range(CHUNK):
        own = lack <= i
        byte = np.where(own, data[np.maximum(at + i, 0)], 0).astype(np.uint32)
        state[front & (lack == i)] = 0xFFFFFFFF
        state = _step(state ^ byte, TABLE)
    out = state[first]
    for i in range(1, int(chunks.max())):
        more = np.flatnonzero(chunks > i)
        s = out[more]
        s = OVER[0][s & 255] ^ OVER[1][(s >> 8) & 255] ^ OVER[2][(s >> 16) & 255] ^ OVER[3][s >> 24]
        out[more] = s ^ state[first[more] + i]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(doc_ids: list[int], ids: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the records, size of each)."""
    payload = 9 + width * counts
    sizes = payload + 16
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    raw = ids.astype("<u2" if width == 2 else "<u4").view(np.uint8)
    upto = width * (np.cumsum(counts) - counts)
    view = memoryview(out)
    for d, a, p, u in zip(doc_ids, at.tolist(), payload.tolist(), upto.tolist(), strict=True):
        struct.pack_into("<Q", view, a, p)
        struct.pack_into("<qB", view, a + 12, d, width)
        out[a + 21 : a + 12 + p] = raw[u : u + p - 9]
    for where, crc in ((at + 8, crc32c(out, at, np.full(len(at), 8))), (at + 12 + payload, crc32c(out, at + 12, payload))):
        four = masked(crc).astype("<u4").view(np.uint8).reshape(-1, 4)
        for i in range(4):
            out[where + i] = four[:, i]
    return out, sizes


class Damaged(ValueError):
    """A checksum doesn't fit."""


def records(stream, block: int = 4_000_000):
    """(doc_id, ids) of each record of an open file, which is read block by block."""
    rest = b""
    while True:
        more = stream.read(block)
        data = rest + more
        starts, sizes, at = [], [], 0
        while at + 12 <= len(data):
            size = struct.unpack_from("<Q", data, at)[0]
            if at + 16 + size > len(data):
                break
            starts.append(at)
            sizes.append(size)
            at += 16 + size
        a, n, raw = np.array(starts, np.int64), np.array(sizes, np.int64), np.frombuffer(data, np.uint8)
        for where, crc in ((a + 8, crc32c(raw, a, np.full(len(a), 8))), (a + 12 + n, crc32c(raw, a + 12, n))):
            said = sum(raw[where + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4)) if len(a) else crc
            if (said != masked(crc)).any():
                raise Damaged("checksum")
        for x, size in zip(starts, sizes, strict=True):
            doc_id, width = struct.unpack_from("<qB", data, x + 12)
            yield (None if doc_id == NO_ID else doc_id), np.frombuffer(data, "<u2" if width == 2 else "<u4", (size - 9) // width, x + 21)
        rest = data[at:]
        if not more:
            if rest:
                raise Damaged("a record is cut off")
            return


def opened(path: str, write: bool = False, seek: bool = False):
    """A stream on a path of any store that Arrow reaches: executors share these files. seek: one that can be read at any place."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if write:
        store.create_dir(inner.rsplit("/", 1)[0])
        return store.open_output_stream(inner)
    return store.open_input_file(inner) if seek else store.open_input_stream(inner)


class Encoder:
    """The tokenizers library. Its model is asked once for each distinct pre-token, which gives the ids of whole texts, since it never merges over their bounds; a text with one of the added tokens, which the library cuts out before that, goes to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = (x for x in range(256) if x not in set(plain))
        self.signs = {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(others)}
        self.memory = Memory()
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def some(self, words: list[bytes]) -> list[list[int]]:
        tokenize, signs = self.tokenizer.model.tokenize, self.signs
        return [[t.id for t in tokenize(w.decode("latin-1").translate(signs))] for w in words]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        has = np.zeros(len(texts), bool)
        for token in self.added:
            has |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(False)
        plain = pc.if_else(pa.array(has), pa.scalar("", texts.type), texts) if has.any() else texts
        ids, counts = encoded(pretokens(plain), lambda data, off: self.memory.lists(pieces(data, off), self.some))
        whole = [self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(has).tolist()]
        if whole:  # the other texts' ids, with these in their places
            size = np.fromiter(map(len, whole), np.int64, len(whole))
            at = np.repeat((np.cumsum(counts) - counts)[has], size)
            ids, counts = np.insert(ids, at, np.concatenate([np.array(x, np.uint32) for x in whole])), counts.copy()
            counts[has] = size
        return ids, counts


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the records of docs under out, each text's ids then end_id, and returns the index. tokenizer: path of a byte-level BPE file of the tokenizers library."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        if tokenizer not in _built:
            _built[tokenizer] = Encoder(tokenizer)
        encoder = _built[tokenizer]
        width = 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4
        path, stream, offset, record = f"{out}/data/{uuid.uuid4().hex}.rec", None, 0, 0
        try:
            for b in text_batches(batches):
                ids, counts = encoder(b.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                doc_ids = [NO_ID if x is None else x for x in b.column(0).to_pylist()]
                data, sizes = frames(doc_ids, ids, counts, width)
                stream = stream or opened(path, True)
                stream.write(data)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n, pa.string()), pa.array(np.arange(record, record + n)), b.column(0), pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(counts)],
                    ["path", "record", "doc_id", "offset", "n_bytes", "n_tokens"],
                )
                offset, record = offset + len(data), record + n
        finally:
            if stream is not None:
                stream.close()

    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, INDEX).write.parquet(f"{out}/index")
    return spark.read.schema(INDEX).parquet(f"{out}/index")


def read_records(spark: SparkSession, out: str, digest) -> DataFrame:
    """A row for each record of the files under out: doc_id, start (ids of all records before it), n_tokens, digest (what digest(ids) gives, a long). Each file is streamed; files are ordered by their first record."""
    index = spark.read.schema(INDEX).parquet(f"{out}/index")
    # one row for each file: the only thing that is ordered as a whole
    files = index.groupBy("path").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("least"), F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("most"), F.sum("n_tokens").alias("n"))
    files = files.select("path", (F.sum("n").over(W.orderBy("least", "most", "path").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: tuple[list, list, list, list] = ([], [], [], [])
                with opened(path) as stream:
                    for doc_id, ids in records(stream):
                        for column, x in zip(rows, (doc_id, base, len(ids), digest(ids)), strict=True):
                            column.append(x)
                        base += len(ids)
                        if len(rows[0]) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "n_tokens", "digest"])
                            rows = ([], [], [], [])
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "n_tokens", "digest"])

    spread = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(spread, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, digest long")


def fetch(wanted: DataFrame) -> DataFrame:
    """wanted (rows of an index, in any order and of any files) with ids: each record is read at its offset alone, and its checksums are tested. Rows keep their partitions and order."""
    small_batches(wanted.sparkSession)

    def run(batches):
        import io

        for b in batches:
            at = {c: b.schema.get_field_index(c) for c in ("path", "offset", "n_bytes")}
            path, offset, size = (b.column(at[c]).to_pylist() for c in ("path", "offset", "n_bytes"))
            files: dict = {}
            try:
                for start in range(0, b.num_rows, FETCHED):
                    ids = []
                    for p, o, n in zip(path[start : start + FETCHED], offset[start : start + FETCHED], size[start : start + FETCHED], strict=True):
                        if p not in files:
                            while len(files) >= OPEN:
                                files.pop(next(iter(files))).close()
                            files[p] = opened(p, seek=True)
                        ids += [x for _, x in records(io.BytesIO(files[p].read_at(n, o)))]
                    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
                    flat = np.concatenate(ids).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.slice(start, FETCHED).columns, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))], [*b.schema.names, "ids"])
            finally:
                for f in files.values():
                    f.close()

    return wanted.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema) + ", ids array<int>")


def shuffled(spark: SparkSession, out: str, seed: int) -> DataFrame:
    """All records under out in a pseudo-random order: only rows of the index are moved, and the records are read where they are."""
    index = spark.read.schema(INDEX).parquet(f"{out}/index").withColumn("turn", F.xxhash64("path", "record", F.lit(seed)))
    return fetch(index.repartitionByRange("turn").sortWithinPartitions("turn")).drop("turn")
