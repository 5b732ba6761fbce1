"""Near-duplicate classes by ProbMinHash, banding and verification.

Shingles are five consecutive words (a shorter text is one shingle), weighted by how often
the text has them. For each shingle a Poisson process of the rate of its weight sends
arrivals to random components; a component keeps the shingle of its earliest arrival, and a
process ends when it is past the latest of them (Ertl's ProbMinHash1). The share of equal
components estimates the probability Jaccard similarity; 24 bands of 4 components make
candidates, at 0.8 all but 4 of a million pairs. A text that repeats a shingle has the bands of
the same signature with all weights 1 as well (that of other texts is their own), so that
pairs of 0.8 plain Jaccard are candidates as surely, however often their shingles repeat.

Equal texts are one member. In a bucket of at most SMALL members all pairs are candidates. In
a larger one every member is held against the least, then, if it is in another class still,
against a pseudo-random one: n - 1 pairs each, which put large classes together. What such
buckets hold of different classes after that goes to links_apart(), which compares all of it
inside tasks by lists of shingles. So no link that a bucket
has is lost, and a bucket's pairs are never written out. Candidates are verified on all their
shingles (64-bit hashes of the words): exact probability Jaccard or exact Jaccard of 0.8 or
more. Links are joined by components().

Null doc_ids are in no class (class_id is null). Null, empty and blank texts have no shingle:
those of equal text are one class. Rows of one doc_id and text are one member; different texts
of one doc_id are members each. Only doc_id and text are read. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE_WORDS, U64, Block, mix, ranges, text_batches, window_hashes
from .bpe import binary
from .components import components
from .common import bit_set, id_and_text, small_batches, written

WORDS, ALIKE, BANDS, ROWS, SMALL = 5, 0.8, 24, 4, 8
#: Bytes of shingles in a block of a cluster, and what each member counts beside its own.
BLOCK, MEMBER = 8_000_000, 200
#: Bits of the set of texts that share a bucket: 16 MB.
BITS = 1 << 27


def shingles(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, 64-bit shingle, times) of each distinct shingle, ordered by these."""
    spans = Block(texts).words(SPACE_WORDS)
    hashes = spans.hashes()
    at, h = spans.windows(hashes, k)
    docs, parts = [spans.docs()[at]], [h]
    for n in range(1, k):
        short = np.flatnonzero(spans.counts == n)
        docs.append(short)
        parts.append(window_hashes(hashes, spans.first[short], n))
    doc, h = np.concatenate(docs), np.concatenate(parts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash of n texts: an n x m array of shingles; texts without shingles have zeros."""
    first = np.full(n * m, np.inf)
    out = np.zeros(n * m, U64)
    d, s, w = doc, shingle, weight.astype(float)
    t, latest, i = np.zeros(len(d)), np.full(n, np.inf), 0
    while len(d):
        r = mix(s * U64(0x9E3779B97F4A7C15) + U64(i * 0xD1B54A32D192ED03 % 2**64))
        t = t - np.log(((r >> U64(11)).astype(float) + 0.5) / 2.0**53) / w
        go = t < latest[d]
        d, s, w, t, r = d[go], s[go], w[go], t[go], r[go]
        cell = d * m + (mix(r ^ U64(0xA0761D6478BD642F)) % U64(m)).astype(np.int64)
        np.minimum.at(first, cell, t)
        won = first[cell] == t
        out[cell[won]] = s[won]
        own = np.unique(d)
        latest[own] = first.reshape(n, m)[own].max(1)
        i += 1
    return out.reshape(n, m)


def key_of(text: Column) -> Column:
    """SHA-256 of a text: equal texts are told by it."""
    return F.unhex(F.sha2(text, 256))


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key (SHA-256 of the text), bands (a hash of each band; then, for texts that repeat a shingle, those with all weights 1; none for texts without words)."""

    def hashed(doc: np.ndarray, s: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        z = signatures(doc, s, times, n, bands * rows)
        h = np.zeros((n, bands), U64)
        for i in range(rows):
            h = mix(h * U64(31) + z[:, i::rows] + U64(i + 1))
        return mix(h + np.arange(bands).astype(U64)[None, :]).view(np.int64)

    def run(batches):
        for b in text_batches(batches):
            doc, s, times = shingles(b.column(1))
            has = np.unique(doc)
            often = np.unique(doc[times > 1])
            own = np.isin(doc, often)
            ends = np.zeros(b.num_rows + 1, np.int64)
            ends[has + 1] = bands
            ends[often + 1] = 2 * bands
            ends = np.cumsum(ends)
            flat = np.zeros(ends[-1], np.int64)
            flat[ends[has][:, None] + np.arange(bands)] = hashed(doc, s, times, b.num_rows)[has]
            flat[ends[often][:, None] + bands + np.arange(bands)] = hashed(np.searchsorted(often, doc[own]), s[own], np.ones(int(own.sum())), len(often))
            flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), flat], ["doc_id", "text_key", "bands"])

    rows_in = docs.select("doc_id", "text", key_of(F.col("text")).alias("text_key"))
    return rows_in.mapInArrow(run, "doc_id long, text_key binary, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """id, shingles: each shingle (u64), sorted; times: how often (u32), null where each is there once. Of texts (id, text)."""

    def run(batches):
        for b in text_batches(batches):
            doc, s, times = shingles(b.column(1))
            ends = np.searchsorted(doc, np.arange(b.num_rows), "right")
            often = np.bincount(doc[times > 1], minlength=b.num_rows) > 0
            weights = binary(times.astype(np.uint32).view(np.uint8), 4 * ends)
            yield pa.RecordBatch.from_arrays([b.column(0), binary(s.view(np.uint8), 8 * ends), pc.if_else(pa.array(often), weights, pa.scalar(None, pa.binary()))], ["id", "shingles", "times"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles binary, times binary")


def likeness(x: np.ndarray, y: np.ndarray, times_x: np.ndarray | None = None, times_y: np.ndarray | None = None) -> tuple[float, float]:
    """(probability Jaccard, Jaccard) of two sorted shingle sets and their weights (None: all 1), exactly."""
    at = np.searchsorted(y, x)
    hit = y[np.minimum(at, len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
    n = int(hit.sum())
    if not n:
        return 0.0, 0.0
    plain = n / (len(x) + len(y) - n)
    if times_x is None and times_y is None:
        return plain, plain
    wa = np.ones(len(x)) if times_x is None else times_x.astype(float)
    wb = np.ones(len(y)) if times_y is None else times_y.astype(float)
    ca, cb = wa[hit], wb[at[hit]]
    # sum over y of max(a_y / a_x, b_y / b_x): those of b_y / a_y up to b_x / a_x count by a, the others by b
    only_a, only_b = wa.sum() - ca.sum(), wb.sum() - cb.sum()
    ratio = cb / ca
    order = np.argsort(ratio, kind="stable")
    upto = np.searchsorted(ratio[order], ratio, "right")
    sum_a = np.concatenate([[0], np.cumsum(ca[order])])[upto] + only_a
    sum_b = cb.sum() - np.concatenate([[0], np.cumsum(cb[order])])[upto] + only_b
    return float((1 / (sum_a / ca + sum_b / cb)).sum()), plain


def verified(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """u, v, similarity of the pairs (u, v) that reach alike."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):  # views of the batch's bytes: nothing is copied but what is compared
                b = batch.slice(start, 200)
                u, v, sim = [], [], []
                blob = lambda x, t: np.frombuffer(x.as_buffer(), t) if x.is_valid else None
                for p, q, x, y, tx, ty in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4), b.column(5), strict=True):
                    s = max(likeness(blob(x, U64), blob(y, U64), blob(tx, np.uint32), blob(ty, np.uint32)))
                    if s >= alike - 1e-12:
                        u.append(p)
                        v.append(q)
                        sim.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], ["u", "v", "similarity"])

    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"), F.col("times").alias("ta"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"), F.col("times").alias("tb"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b", "ta", "tb").mapInArrow(run, "u long, v long, similarity double")


def _pairs_within(shared: DataFrame, most: int) -> DataFrame:
    """All pairs of the buckets of 2 to most members. shared: bucket, id, n."""
    own = shared.where(F.col("n") <= most)
    other = own.select("bucket", F.col("id").alias("v"))
    return own.select("bucket", F.col("id").alias("u")).join(other, "bucket").where("u > v").select("u", "v")


def _apart(rows: DataFrame) -> DataFrame:
    """The buckets of rows (bucket, id, label) that hold different labels."""
    return rows.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("bucket")


def links_within(ids: np.ndarray, classes: np.ndarray, sets: list, times: list, alike: float) -> list[tuple[int, int, float]]:
    """Links (u > v, similarity) that put together all members of a group that are alike and of different classes: exactly, over all pairs of different classes, by the lists of the shingles. Two classes that have come together are one from then on."""
    n, size = len(ids), np.fromiter(map(len, sets), np.int64, len(sets))
    kinds, classes = np.unique(classes, return_inverse=True)
    if len(kinds) < 2 or not size.sum():
        return []
    weights = [np.ones(k) if t is None else t.astype(float) for k, t in zip(size.tolist(), times, strict=True)]
    often = np.fromiter((t is not None for t in times), bool, n)
    off = np.concatenate([[0], np.cumsum(size)])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, share = np.repeat(np.arange(n), size)[order], np.concatenate([w / max(1.0, w.sum()) for w in weights])
    posted, first = share[order], np.searchsorted(code[order], np.arange(code.max() + 2))
    many_of, out = np.diff(first), []
    # a pair of different classes has a member that isn't of the largest one
    for x in np.flatnonzero(classes != np.bincount(classes).argmax()).tolist():
        own = code[off[x] : off[x + 1]]
        if not len(own):
            continue
        many = many_of[own]
        # whoever is alike has that share of x's shingles, by number or by weight, so one of the rarest, as many as leave less than it
        rarest = np.argsort(many, kind="stable")
        even = np.full(len(own), 1 / len(own))
        upto = max(_prefix(even, alike), _prefix(share[off[x] : off[x + 1]][rarest], alike))
        at = ranges(first[own[rarest[:upto]]], many[rarest[:upto]])
        if (classes[owner[at]] == classes[x]).all():
            continue
        other = classes != classes[x]
        at = ranges(first[own], many)
        common = np.bincount(owner[at], minlength=n)
        alike_to = np.where(common > 0, common / np.maximum(1, size[x] + size - common), 0.0)
        if often[x] or often.any():
            # a probability Jaccard of alike needs that share of both sides in common
            mine, theirs = np.bincount(owner[at], np.repeat(share[off[x] : off[x + 1]], many), n), np.bincount(owner[at], posted[at], n)
            for y in np.flatnonzero(other & (often | often[x]) & (alike_to < alike) & (mine >= alike - 1e-9) & (theirs >= alike - 1e-9)).tolist():
                alike_to[y] = max(alike_to[y], likeness(sets[x], sets[y], times[x], times[y])[0])
        near = np.flatnonzero(other & (alike_to >= alike - 1e-12))
        while len(near):
            y = int(near[0])
            out.append((max(int(ids[x]), int(ids[y])), min(int(ids[x]), int(ids[y])), float(alike_to[y])))
            classes[classes == classes[y]] = classes[x]
            near = near[classes[near] != classes[x]]
    return out


def _prefix(mass: np.ndarray, alike: float) -> int:
    """How many of the first shares of a whole leave less than alike."""
    return int(np.searchsorted(np.cumsum(mass), 1 - alike + 1e-9, "right")) + 1


def links_apart(left: DataFrame, stars: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """u, v, similarity: links that put together all members of left (id, label) that share a bucket, have different labels and are alike. stars: (u, v) that lead from each member to the least of its buckets.

    Members that buckets connect are a cluster, which holds every pair of each of its buckets once.
    A cluster of more than BLOCK bytes of shingles, to which each member adds MEMBER, is cut into blocks, and every two blocks meet in
    a task. No pair is written: only links are."""
    cluster = components(stars).select("id", F.col("label").alias("cluster"))
    rows = left.join(cluster, "id").join(sets, "id")
    rows = written(rows.select("cluster", "id", "label", "shingles", "times"), "clusters")
    blocks = rows.groupBy("cluster").agg((F.floor(F.sum(F.octet_length("shingles") + F.coalesce(F.octet_length("times"), F.lit(0)) + MEMBER) / BLOCK) + 1).cast("int").alias("blocks"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("cluster", "blocks")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own")))
    dealt = rows.join(blocks, "cluster").withColumn("own", own).select("*", F.explode(others).alias("other"))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "label", "shingles", "times")
    dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")

    def run(batches):
        key, rows = None, []

        def done():
            links = links_within(*(np.array([r[i] for r in rows]) for i in (0, 1)), [r[2] for r in rows], [r[3] for r in rows], alike) if rows else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["u", "v", "similarity"])

        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            ids, labels = b.column(3).to_pylist(), b.column(4).to_pylist()
            for i, k in enumerate(keys):
                if k != key:
                    yield done()
                    key, rows = k, []
                shingle, time = b.column(5)[i], b.column(6)[i]
                rows.append((ids[i], labels[i], np.frombuffer(shingle.as_buffer().to_pybytes(), U64), np.frombuffer(time.as_buffer().to_pybytes(), np.uint32) if time.is_valid else None))
        yield done()

    return dealt.mapInArrow(run, "u long, v long, similarity double")


def maybe_wanted(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of keyed whose hash of (doc_id, text_key) is one of wanted's, so that few texts but those that the join keeps are shuffled for it."""
    bit = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(BITS)).alias("bit")
    bits = keyed.sparkSession.sparkContext.broadcast(bit_set(wanted.select(bit), BITS))

    @F.pandas_udf("boolean")
    def has(at: pd.Series) -> pd.Series:
        h = at.to_numpy()
        return pd.Series(bits.value[h >> 3] >> (h & 7).astype(np.uint8) & 1 == 1)

    return keyed.where(has(bit))


def near_classes(docs: DataFrame, alike: float = ALIKE, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """doc_id, text_key, text_id (least doc_id of the same text), class_id (least doc_id of the class), class_key (least text_key of the rows of class_id in the class), a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    drawn = written(sketch(docs, bands, rows), "sketch")
    known = drawn.where("doc_id is not null")
    members = known.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    members = written(members.withColumn("id", F.monotonically_increasing_id()), "members")
    drawn_bands = members.select("id", "bands", F.posexplode("bands").alias("band", "bucket"))
    # a bucket has a member once: a band with all weights 1 may be the weighted one
    fresh = (F.col("band") < bands) | (F.col("bucket") != F.element_at("bands", F.greatest(F.col("band") - bands + 1, F.lit(1))))
    buckets = written(drawn_bands.where(fresh).select("id", "bucket"), "buckets")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min_by("id", F.xxhash64("id", "bucket")).alias("other")).where("n > 1")
    sizes = written(sizes, "sizes")  # so that the join below can be split where a bucket is large
    # most buckets have one member: all that follows reads the others alone
    shared = written(buckets.join(sizes, "bucket"), "shared")
    large = shared.where(F.col("n") > small)
    stars = large.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    pairs = written(_pairs_within(shared, small).unionByName(stars).distinct(), "pairs")
    # all that share a bucket, so that the texts are read once for all rounds
    wanted = members.select("doc_id", "text_key", "id").join(shared.select("id").distinct(), "id", "left_semi")
    wanted = written(wanted, "wanted")
    keyed = maybe_wanted(docs.withColumn("text_key", key_of(F.col("text"))), wanted)
    texts = keyed.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    sets = written(shingle_sets(texts), "sets")
    links = written(verified(pairs, sets, alike).select("u", "v"), "links")
    labels = written(components(links), "labels")

    def left() -> DataFrame:
        """The members of large buckets that hold different classes still."""
        own = large.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        return own.join(_apart(own), "bucket")

    # each against a pseudo-random member of its bucket, so that large classes come together
    own = left()
    named = own.where(F.col("id") == F.col("other")).select("bucket", F.col("label").alias("its"))
    again = own.join(named, "bucket").where("label <> its").select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).distinct()
    again = written(again.join(pairs, ["u", "v"], "left_anti"), "again")
    if again.head(1):
        links = links.unionByName(written(verified(again, sets, alike).select("u", "v"), "links"))
        labels = written(components(links), "labels")
    # all other pairs of different classes that are alike
    own = written(left().select("id", "label", "least"), "left")
    if own.head(1):
        stars = own.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
        more = written(links_apart(own.select("id", "label").distinct(), stars, sets, alike).select("u", "v"), "more")
        if more.head(1):
            links = links.unionByName(more)
            labels = written(components(links), "labels")
    named = members.join(labels, "id", "left").select("text_key", F.col("doc_id").alias("text_id"), F.coalesce("label", "id").alias("label"))
    named = written(named, "named")
    classes = named.groupBy("label").agg(F.min(F.struct("text_id", "text_key")).alias("least")).select("label", F.col("least.text_id").alias("class_id"), F.col("least.text_key").alias("class_key"))
    out = known.select("doc_id", "text_key").join(named.join(classes, "label").drop("label"), "text_key").select("doc_id", "text_key", "text_id", "class_id", "class_key")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("text_id", "long"), ("class_id", "long"), ("class_key", "binary"))]
    return out.unionByName(drawn.where("doc_id is null").select("doc_id", "text_key", *none))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, the one of least doc_id (of several texts with it, that of class_key; of several rows with both, that of the least hash of its columns); rows without doc_id stay."""
    kept = near_classes(docs, **options).where("doc_id is not null").select(F.struct(F.col("class_id").alias("doc_id"), F.col("class_key").alias("key")).alias("kept")).distinct()
    inner = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), key_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key")).alias("kept"), F.struct("*").alias("row"))
    known = inner.where("kept.doc_id is not null").join(kept, "kept", "left_semi").groupBy("kept").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return known.unionByName(inner.where("kept.doc_id is null")).select("row.*")
