"""Every query of the domain against its SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from wavelake.plans import ORACLES, QUERIES  # noqa: E402

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return c


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, AT)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted((str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect()))
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, AT).collect()
