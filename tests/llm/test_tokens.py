"""Encoding against the public libraries, and exact round trips."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wavelake.llm import bpe, queries, records
from wavelake.llm.common import scratch
from wavelake.llm.pretokens import pretokens

RANKS = P.path("byte_bpe_50k.tiktoken")
signs = st.text(st.one_of(st.sampled_from(list("abA1 \n\t'.,strvelmdé漢 　!")), st.characters(exclude_categories=["Cs"])), max_size=40)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(signs, min_size=1, max_size=6))
def test_pretokens_are_the_patterns(texts):
    s = pretokens(pa.array(texts))
    raw = s.block.data.tobytes()
    own = [raw[a:b].decode() for a, b in zip(s.starts, s.ends)]
    assert [own[a:b] for a, b in zip(s.first[:-1], s.first[1:])] == [regex.findall(P.PATTERN, t) for t in texts]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    h = bpe.PerfectHash(keys)
    assert sorted(h(keys).tolist()) == list(range(len(keys)))


def test_encode_is_tiktokens_and_decodes_back(spark, docs, library):
    got = {(r.doc_id, bytes(r.decoded).decode()): r for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()}
    rows = docs.collect()
    assert len(got) == len({(r.doc_id, r.text or "") for r in rows})
    for r in rows:
        x = got[r.doc_id, r.text or ""]
        ids = library.encode_ordinary(r.text or "")
        assert np.frombuffer(x.ids, "<u4").tolist() == ids and x.n_tokens == len(ids)


def test_op10_on_the_small_table(spark, library):
    at = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op10_byte_bpe(spark, at).collect()}
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        x = got[r.doc_id]
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def twins(bits: int) -> tuple[str, str]:
    """The Thue-Morse word of 2 ** bits letters and its letter-swapped twin: polynomial hashes modulo powers of two can't tell them apart."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_texts_whose_sums_cancel_out_keep_their_own_ids(spark, library):
    texts = [x for bits in (10, 11, 12) for x in twins(bits)] + ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", "plain", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in bpe.round_trip(rows, RANKS).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]
    out, t = scratch(spark, "t"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    records.write_records(rows, out, P.path("byte_bpe_50k.json"), 2)
    got = {r.doc_id: r for r in records.shuffled(spark, out, 5).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}


def test_the_index_reads_in_any_order(spark, docs):
    out = scratch(spark, "t")
    index = records.write_records(docs, out, P.path("byte_bpe_50k.json"), 2)
    orders = [[(r.path, r.record) for r in records.shuffled(spark, out, seed).collect()] for seed in (1, 2)]
    assert sorted(orders[0]) == sorted(orders[1]) == sorted((r.path, r.record) for r in index.collect()) and orders[0] != orders[1]
    one = index.where("doc_id is not null").orderBy("doc_id").limit(1)
    assert len(records.fetch(one).first().ids) == one.first().n_tokens
    assert records.fetch(index.limit(0)).count() == 0


def plain_crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    assert plain_crc32c(b"123456789") == 0xE3069283
    data = np.random.default_rng(2).integers(0, 256, 4000).astype(np.uint8)
    sizes = np.array([4, 9, 255, 256, 257, 512, 1300])
    starts = np.cumsum(sizes) - sizes
    assert records.crc32c(data, starts, sizes).tolist() == [plain_crc32c(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]


def test_records_round_trip(spark, docs):
    out = scratch(spark, "t")
    index = records.write_records(docs, out, P.path("byte_bpe_50k.json"), 2).collect()
    got = sorted((r.start, r.doc_id, r.n_tokens, r.digest) for r in records.read_records(spark, out, queries.crc_of).collect())
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((start, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    for r in index:  # the index leads to each record
        with open(r.path.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            blob = f.read(r.n_bytes)
        assert struct.unpack_from("<Q", blob)[0] == r.n_bytes - 16
    path = index[0].path.removeprefix("file://")
    blob = bytearray(open(path, "rb").read())
    blob[25] ^= 1
    import io

    with pytest.raises(records.Damaged):
        list(records.records(io.BytesIO(bytes(blob))))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0
    out = scratch(spark, "t")
    records.write_records(none, out, P.path("byte_bpe_50k.json"), 2)
    assert records.read_records(spark, out, queries.crc_of).count() == 0


def test_words_merged_at_once_are_those_merged_one_by_one():
    v = bpe.Vocabulary(open(RANKS, "rb").read())
    rnd = np.random.default_rng(5)
    words = [bytes(rnd.integers(0, 256, n).tolist()) for n in range(1, 41) for _ in range(20)] + [bytes(rnd.choice(list(b" aabnht'"), n).tolist()) for n in range(1, 41) for _ in range(40)] + [b"a" * n for n in range(1, 41)]
    assert v.merged(words) == [bpe.merged(w, v.ranks) for w in words]
    own = {w: v.ranks[w] for w in (b"a", b"b", b"ab")}  # without most bytes
    assert bpe.Vocabulary(b"\n".join(base64.b64encode(w) + b" %d" % r for w, r in own.items())).merged([b"abba"] * 40) == [bpe.merged(b"abba", own)] * 40
