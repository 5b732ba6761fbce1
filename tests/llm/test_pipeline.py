"""Each stage of the pipeline against a plain version on its own input."""

import hashlib
import re

import corpus_pipeline as c
import pytest

from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_probminhash import brute as classes
from tests.llm.test_substring_dedup import brute as passages
from wavelake.llm import quality
from wavelake.llm.common import written

AT = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The table before each stage, and the last."""
    out = [spark.read.parquet(f"{AT}/documents.parquet")]
    for name, f in c.STAGES:
        out.append(written(f(spark, out[-1], AT), "stage"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [len(x) for x in c.STAGES] == [2] * 5
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_quality(spark, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{AT}/labels.parquet"))
    want = {r.doc_id for r in quality.score(stages[0], model).collect() if r.score >= 0.3}
    assert rows(stages[1]) == {k: r for k, r in rows(stages[0]).items() if k in want} and len(want) < stages[0].count()


def test_near_duplicates(stages):
    before = rows(stages[1])
    label = classes([(k, re.sub(r"\xa0", "\xa0", r.text)) for k, r in before.items()])
    assert rows(stages[2]) == {k: r for k, r in before.items() if label[k] == k}


def test_repeated_passages(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = {d: (n, gone, sha) for d, n, gone, sha in passages([(k, r.text) for k, r in before.items()], 50)}
    assert set(after) == set(before)
    for k, r in after.items():
        if want[k][1]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[k][2] and r.n_chars == len(r.text)
            assert r[2:4] == before[k][2:4]
        else:
            assert r == before[k]


def test_benchmark_leaks(spark, stages):
    before = rows(stages[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    bad = {r[0] for r in leaks([(k, r.text) for k, r in before.items()], items) if r[5]}
    assert rows(stages[4]) == {k: r for k, r in before.items() if k not in bad}


def test_token_ids(stages):
    before, after = rows(stages[4]), rows(stages[5])
    assert set(after) == set(before)
    for k, r in after.items():
        assert r.decoded_sha256 == hashlib.sha256(before[k].text.encode()).hexdigest() and len(r.ids) == 4 * r.n_tokens


def test_run(spark, stages):
    assert {k: r.ids_sha256 for k, r in rows(c.run(spark, AT)).items()} == {k: r.ids_sha256 for k, r in rows(stages[5]).items()}


CLASHING = ("its_id", "its_hash", "its_text", "its_key", "key", "row", "kept", "changed", "id", "bucket", "anchors", "copy", "part", "removed", "hits", "items", "label", "score", "class_id", "text_key")


def test_columns_of_clashing_names(spark, stages):
    """Each stage keeps the same rows when documents has columns with the names that operators use inside."""
    for (name, f), docs in zip(c.STAGES[:-1], stages, strict=False):
        more = docs.selectExpr("*", *(f"concat('{x} ', doc_id) as {x}" for x in CLASHING))
        got = f(spark, more, AT)
        assert got.columns == more.columns, name
        want = rows(f(spark, docs, AT))
        for r in got.collect():
            assert r[: len(COLUMNS)] == want.pop(r.doc_id) and all(r[x] == f"{x} {r.doc_id}" for x in CLASHING), name
        assert not want
    docs = stages[-2]
    more = docs.selectExpr("*", *(f"concat('{x} ', doc_id) as {x}" for x in CLASHING))
    assert rows(c.STAGES[-1][1](spark, more, AT)) == rows(stages[-1])


def test_odd_rows(spark):
    long, plain = "word " * 20_000, "Some ordinary words that stand in a row, and some more of them."
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, plain, "en", "s", 5), (3, long, None, "s", 100_000), (4, "a b c d e f", "en", None, 11), (4, "other text", "en", None, 10), (5, "other text", "en", None, 10)], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    # null and empty texts are one class, two texts of one doc_id are two
    kept = c.near_duplicates(spark, odd, AT)
    assert key(kept) == sorted([(1, None), (None, plain), (3, long), (4, "a b c d e f"), (4, "other text")], key=str)
    assert key(c.repeated_passages(spark, kept, AT)) == key(kept) == key(c.benchmark_leaks(spark, kept, AT))
    assert {r.doc_id: r.n_tokens for r in c.token_ids(spark, kept.where("doc_id = 1 or doc_id is null"), AT).collect()}[1] == 0
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for _, f in c.STAGES:
            docs = written(f(spark, docs, AT), "stage")
            assert docs.count() <= n
            n = docs.count()
