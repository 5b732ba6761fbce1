"""Order MinHash against a plain version of its definition."""

import hashlib
import random
import re

import xxhash

from wavelake.llm import order_minhash as o
from wavelake.llm import queries


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx_words(text):
    return signed(xxhash.xxh64(text.encode(), seed=42).intdigest())


def xx_longs(values):
    """Spark's hash of several longs: each seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64((v & (2**64 - 1)).to_bytes(8, "little"), seed=seed).intdigest()
    return signed(seed)


def plain(text, k=2, bins=32, keep=2):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    cut = lambda h: (h & (2**64 - 1)) >> 29  # noqa: E731  the first 35 bits
    if len(w) >= k:
        kmers = [cut(xx_longs([xx_words(x) for x in w[i : i + k]])) for i in range(len(w) - k + 1)]
    else:
        kmers = [cut(xx_words(" ".join(w)))] if w else []
    seen, chosen = {}, {}
    for i, g in enumerate(kmers):
        nth = seen.get(g, 0)
        seen[g] = nth + 1
        # the place in the sorted array is an int there, which hashes as four bytes
        h = cut(signed(xxhash.xxh64(nth.to_bytes(4, "little"), seed=xxhash.xxh64(g.to_bytes(8, "little"), seed=42).intdigest()).intdigest()))
        chosen.setdefault(h >> 30, []).append((h, i))
    out = []
    for b in range(bins):
        own = sorted(chosen.get(b, []))[:keep]
        out.append((xx_longs([h for h, _ in sorted(own, key=lambda x: x[1])]) & (2**64 - 1)) >> 32 if own else None)
    return "".join(o.EMPTY if x is None else f"{x:08x}" for x in out)


def like(a, b):
    a, b = ([x[i : i + 8] for i in range(0, len(x), 8)] for x in (a, b))
    pairs = [(x, y) for x, y in zip(a, b) if x != o.EMPTY or y != o.EMPTY]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def test_against_the_definition(spark):
    rnd = random.Random(4)
    some = lambda n: " ".join(rnd.choice(["a", "b", "c", "é漢", "dd"]) + rnd.choice(["", "", "\n", " "]) for _ in range(n))
    rows = [(i * 3, some(rnd.choice([0, 1, 2, 5, 40, 300]))) for i in range(40)] + [(200, None), (201, ""), (202, "😀" * 10), (None, "none"), (5, "same"), (5, "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, entries int").repartition(3)
    got = sorted(queries.order_minhash_digest(o.edited_pairs(df)).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert len(got) == len(order)
    for i, ((d, t), r) in enumerate(zip(order, got)):
        nxt = order[(i + 1) % len(order)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain(t), plain(e))
        assert abs(r.near_edited - like(plain(t), plain(e))) < 1e-12 and abs(r.near_next - like(plain(t), plain(nxt))) < 1e-12


def test_small_tables(spark):
    assert o.edited_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = o.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert r.edited == "abcdab"


def test_no_python_in_the_plan(spark):
    df = o.edited_pairs(spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
