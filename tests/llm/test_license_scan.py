"""The licence scan against DuckDB and against planted notices."""

import duckdb

from wavelake.llm import license_scan as l


def test_notices_are_found(spark):
    rows = [(1, "Some text.\nReleased under the MIT license\nmore text here"), (2, None), (3, ""), (4, "license"), (5, "Licensed under the Apache License, Version 2.0."), (6, "Nothing of the kind is released under here"), (6, "Nothing of the kind is released under here"), (None, "intro\n\nLicensed under\nCC BY-NC 4.0\n\nend")]
    got = l.scan(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, dice int")).collect()
    assert [(r.doc_id, r.licence, r.n_parts) for r in got] == [(1, "MIT", 1), (2, None, 0), (3, None, 0), (4, None, 0), (5, "Apache-2.0", 1), (6, None, 0), (6, None, 0), (None, "CC-BY-NC-4.0", 3)]
    assert got[4].dice == 1.0


def test_against_duckdb(spark):
    at = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{at}/documents.parquet'")
    want = sorted(c.sql(l.oracle()).fetchall())
    got = sorted((r.doc_id, r.licence, r.dice, r.n_parts) for r in l.scan(spark.read.parquet(f"{at}/documents.parquet")).collect())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want] and any(r[1] for r in got)


def test_empty(spark):
    assert l.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
