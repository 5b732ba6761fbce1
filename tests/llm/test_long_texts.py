"""Very long texts in the operators that compare documents: whole results, no crash."""

import pytest

from wavelake.llm import decontamination, license_scan, order_minhash, probminhash, substring_dedup

LONG = " ".join(f"w{i % 5003}x{i}" for i in range(150_000))
ITEM = " ".join(f"item{i}" for i in range(20))


@pytest.fixture(scope="module")
def long(spark):
    """A long text, its copy, one with a few words changed, and one that is not like them."""
    edited = LONG.replace(" w7x5010 ", " other ").replace(" w9x100069 ", f" {ITEM} ")
    rows = [(1, LONG), (2, LONG), (3, edited), (4, LONG[: len(LONG) // 3] + " " + "z" * 1_000_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_near_duplicates(long):
    assert {r.doc_id: r.class_id for r in probminhash.near_classes(long).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_substrings(long):
    got = {r.doc_id: sum(x.n for x in r.removed) for r in substring_dedup.deduplicated(long, lambda raw: "").collect()}
    assert got[1] == 0 and got[2] == 150_000 and got[3] == 150_000 - 2 and got[4] > 49_000


def test_decontamination(spark, long):
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in decontamination.contamination(long, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (20, False), 4: (0, False)}


def test_fingerprints(long):
    rows = {r.doc_id: r.entries for r in order_minhash.fingerprints(long).collect()}
    alike = lambda a, b: sum(x == y for x, y in zip(rows[a], rows[b], strict=True)) / len(rows[a])
    assert alike(1, 2) == 1 and alike(1, 3) > 0.8 and alike(1, 4) < 0.6


def test_licences(long):
    assert license_scan.scan(long).count() == 4
