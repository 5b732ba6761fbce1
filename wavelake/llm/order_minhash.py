"""Order MinHash in DataFrame functions alone.

A k-mer is K consecutive words of a text; its occurrence number tells repeats apart, as in
Marcais and others' order min hash. Each numbered k-mer has a hash; the hash's first bits
choose one of BINS bins (one permutation serves all bins), and a bin keeps its KEEP least
k-mers. They go back into the order of the text, and the hash of that sequence is the bin's
entry: so it depends on which k-mers are near and on their order, as edit distance does. The
fingerprint is the entries as hex, "--------" for a bin without k-mers. The likeness of two
fingerprints is the share of equal bins among those that either has.

All is done within the row: k-mers are numbers of 63 bits (hash, then place), sorted twice.
The occurrence number is the distance to the first of equals in the sorted array, found by
halving steps. No k-mer is shuffled.

A text of fewer than K words is one k-mer of what it has; null, empty and blank texts have no
k-mers, and two such fingerprints are alike (1.0). Equal texts have equal fingerprints. Rows
without doc_id come after all others. Rows with one doc_id are ordered by text. Other columns
are not read. An empty table gives an empty one; a single row is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, BINS, KEEP = 2, 32, 2
#: Places of a k-mer that fit into a number, and the bits of its hash.
PLACE, HASH = 28, 30
EMPTY = "-" * 8


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def entries(text: Column, k: int = K, bins: int = BINS, keep: int = KEEP) -> Column:
    """The fingerprint of a text as an array of long: an entry for each bin, null without k-mers."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    one = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - 5 - HASH), PLACE).bitwiseOR(i.cast("long"))

    def kmers(w: Column) -> Column:
        """Sorted numbers of all k-mers: hash, then place."""
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        whole = F.array(one(F.xxhash64(F.array_join(w, " ")), F.lit(0)))
        many = lambda h: F.zip_with(F.slice(h, 1, F.size(h) - (k - 1)), F.sequence(F.lit(0), F.size(h) - k), lambda a, i: one(F.xxhash64(a, *(F.get(h, i + j) for j in range(1, k))), i))
        return F.array_sort(F.when(F.size(w) >= k, _let(hashed, many)).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>")))

    def numbered(s: Column) -> Column:
        """Each k-mer's bin, a hash of it and its occurrence number, and its place, as one number; sorted."""
        same = lambda x, y: F.shiftrightunsigned(x, PLACE) == F.shiftrightunsigned(y, PLACE)
        steps = F.array(*(F.lit(1 << b) for b in range(PLACE - 1, -1, -1)))

        def first(x: Column, i: Column) -> Column:
            return F.aggregate(steps, i, lambda at, step: F.when((at >= step) & same(F.get(s, F.greatest(at - step, F.lit(0))), x), at - step).otherwise(at))

        def number(x: Column, i: Column) -> Column:
            repeat = (i > 0) & same(F.get(s, F.greatest(i - 1, F.lit(0))), x)
            nth = F.when(repeat, i - first(x, i)).otherwise(F.lit(0))
            return one(F.xxhash64(F.shiftrightunsigned(x, PLACE), nth), x.bitwiseAND((1 << PLACE) - 1))

        return F.array_sort(F.transform(s, number))

    bin_of = lambda x: F.shiftrightunsigned(x, PLACE + HASH)
    least = lambda s: F.filter(s, lambda x, i: (i < keep) | (bin_of(F.get(s, F.greatest(i - keep, F.lit(0)))) != bin_of(x)))

    def entry(own: Column) -> Column:
        """The hash of a bin's k-mers in the order of the text."""
        placed = F.array_sort(F.transform(own, lambda x: F.struct(x.bitwiseAND((1 << PLACE) - 1).alias("at"), F.shiftrightunsigned(x, PLACE).alias("h"))))
        return F.shiftrightunsigned(F.xxhash64(F.transform(placed, lambda p: p["h"])), 32)

    def binned(chosen: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: _let(F.filter(chosen, lambda x: bin_of(x) == b), lambda own: F.when(F.size(own) > 0, entry(own))))

    return _let(words, lambda w: _let(kmers(w), lambda s: _let(numbered(s), lambda n: _let(least(n), binned))))


def fingerprint(own: Column) -> Column:
    return F.array_join(F.transform(own, lambda x: F.when(x.isNull(), EMPTY).otherwise(F.lower(F.lpad(F.hex(x), 8, "0")))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two arrays of entries."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(x.eqNullSafe(y).cast("int")))
    seen = F.filter(pairs, lambda x: x.isNotNull())
    return _let(seen, lambda s: F.when(F.size(s) == 0, F.lit(1.0)).otherwise(F.aggregate(s, F.lit(0), lambda n, x: n + x) / F.size(s)))


def with_next(docs: DataFrame, fingerprinted) -> DataFrame:
    """doc_id, text, entries of docs (doc_id, text), with next_text and next_entries of the row that follows in descending doc_id; the first follows the last. fingerprinted(rows) adds entries.

    No task orders all rows: doc_id is cut into ranges by approximate quantiles, as many as four
    for each shuffle partition; a copy of the first row of a range is also sent to the range
    before it. Only the least and greatest id of each range pass through the driver. The copies
    are made before texts are fingerprinted, so each text is fingerprinted once."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("id"))
    cuts = sorted(set(ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    if cuts:  # the number of cuts below the id, by halving steps
        steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
        all_cuts = F.array(*map(F.lit, cuts))
        part = lambda x: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.get(all_cuts, F.least(at + s, F.lit(len(cuts))) - 1) < x), at + s).otherwise(at))
    else:
        part = lambda x: F.lit(0)
    heads = sorted(((r.part, r.most) for r in ids.groupBy(part(F.col("id")).alias("part")).agg(F.max("id").alias("most")).collect()), reverse=True)
    # the first row of each range also ends the range of greater ids, and the first of all the last one
    to = {most: heads[i - 1][0] for i, (_, most) in enumerate(heads)}
    rows = docs.select("doc_id", "text", key.alias("id"))
    ends = spark.createDataFrame([(most, p) for most, p in to.items()], "head long, to int")
    once = rows.join(F.broadcast(ends), F.col("id") == F.col("head")).groupBy("id").agg(F.min_by(F.struct("doc_id", "text"), F.col("text")).alias("row"), F.first("to").alias("part"))
    copies = once.select("row.doc_id", "row.text", "id", "part", F.lit(1).alias("copy"))
    both = fingerprinted(rows.withColumn("part", part(F.col("id"))).withColumn("copy", F.lit(0)).unionByName(copies))
    w = W.partitionBy("part").orderBy(F.col("copy"), F.col("id").desc(), "text")
    return both.select("*", F.lead("text").over(w).alias("next_text"), F.lead("entries").over(w).alias("next_entries")).where("copy = 0").select("doc_id", "text", "entries", "next_text", "next_entries")


def fingerprints(docs: DataFrame, k: int = K, bins: int = BINS, keep: int = KEEP) -> DataFrame:
    """doc_id, text (null: empty) and entries."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("entries", entries(F.col("text"), k, bins, keep))


def edited_pairs(docs: DataFrame, k: int = K, bins: int = BINS, keep: int = KEEP) -> DataFrame:
    """doc_id, text, edited (its last third replaced from the next row's text), their entries and the next row's."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts, lambda both: both.withColumn("entries", entries(F.col("text"), k, bins, keep)))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    return rows.withColumn("edited", edited).withColumn("edited_entries", entries(F.col("edited"), k, bins, keep))
