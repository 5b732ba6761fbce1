"""Versioned tables: what a change writes, who reads during it, and a change that never ends. Catalogues of files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from wavelake.operators.results import upsert_latest
from wavelake.sources import store
from wavelake.sources import versions as v

SCHEMA = "id long, run_id long, outcome string"


def size(folder):
    return sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet"))


def told(df):
    return sorted(map(tuple, df.select("id", "run_id", "outcome").collect()))


def test_changes_touch_their_partitions(spark, tmp_path):
    path, part = str(tmp_path / "t"), F.floor(F.col("run_id") / 10)
    rows = spark.range(20_000).select("id", (F.col("id") % 200).alias("run_id"), F.sha2(F.col("id").cast("string"), 256).alias("outcome"))
    assert told(v.read_version(spark, path, SCHEMA)) == [] and v.put_partitions(rows, path, part, set()) == 0
    assert told(v.read_version(spark, path, SCHEMA)) == told(rows)
    old = v.read_version(spark, path, SCHEMA)
    updates = spark.createDataFrame([(5, 5, "rerun"), (5, 5, "later"), (99_999, 7, "new")], SCHEMA).withColumn("id", F.col("id"))
    assert v.upsert_version(spark, path, updates, ["id", "run_id"], "outcome", part) == 1
    new = v.read_version(spark, path, SCHEMA)
    assert told(new) == told(upsert_latest(rows, updates, ["id", "run_id"], "outcome"))
    assert told(old) == told(rows) == told(v.read_version(spark, path, SCHEMA, version=0))
    assert size(f"{path}/data/v=1") < size(f"{path}/data/v=0") / 10
    gone = spark.createDataFrame([(r, r) for r in range(10, 20)], "id long, run_id long")
    assert v.delete_version(spark, path, SCHEMA, gone.select("run_id"), ["run_id"], part) == 2
    assert told(v.read_version(spark, path, SCHEMA)) == [r for r in told(new) if not 10 <= r[1] < 20]
    assert "1" not in v.manifest(spark, path) and "0" in v.manifest(spark, path)


def test_a_change_that_never_ends(spark, tmp_path, monkeypatch):
    path, part = str(tmp_path / "t"), F.col("run_id")
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], SCHEMA)
    v.put_partitions(rows, path, part, set())
    updates = spark.createDataFrame([(1, 1, "c")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            v.upsert_version(spark, path, updates, ["id"], "outcome", part)
    assert os.path.exists(f"{path}/data/v=1") and v.versions(spark, path) == [0]
    assert told(v.read_version(spark, path, SCHEMA)) == told(rows)
    assert v.upsert_version(spark, path, updates, ["id"], "outcome", part) == 1
    assert told(v.read_version(spark, path, SCHEMA)) == [(1, 1, "c"), (2, 2, "b")]


def test_artifact_catalog(spark, tmp_path, monkeypatch):
    """Files of nested folders, of any ending, empty, and too large to be read for a checksum."""
    files = {"a.PCAP": b"\xa1\xb2\x00", "deep/er/b.log": b"line\n", "deep/none": b"", "large.log": b"x" * 100}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(store, "MOST_HASHED", 100)
    got = {r.path.partition(tmp_path.name + "/")[2]: (r["size"], r.kind, r.sha256) for r in store.artifact_catalog(spark, str(tmp_path)).collect()}
    kinds = {"a.PCAP": "pcap", "deep/er/b.log": "log", "deep/none": "", "large.log": "log"}
    assert got == {n: (len(c), kinds[n], None if len(c) >= 100 else hashlib.sha256(c).hexdigest()) for n, c in files.items() if c}
    assert {r.path.rpartition("/")[2] for r in store.artifact_catalog(spark, str(tmp_path), "*.log").collect()} == {"b.log", "large.log"}


def test_members_of_archives(spark, tmp_path):
    """Artifacts in archives are told as those in files of their own are, whoever wrote the archive."""
    import io
    import tarfile

    texts = {f"tag=t{i}/part={i % 3}/{'x' * (i * 7)}.txt": f"é{i}\n" * (i * 37) + "z" * (512 if i == 5 else 0) for i in range(40)} | {"full.txt": "y" * 1024}
    store.write_tars(spark.createDataFrame(list(texts.items()), "name string, content string"), str(tmp_path / "own"), 3)
    assert len(list((tmp_path / "own").glob("*.txt"))) <= 3
    with tarfile.open(tmp_path / "other.tar", "w") as t:
        info = tarfile.TarInfo("deep/b.log")
        info.size = 4
        t.addfile(info, io.BytesIO(b"\x00\xff12"))
    (tmp_path / "plain.log").write_bytes(b"line")
    want = {n: c.encode() for n, c in texts.items() if c} | {"deep/b.log": b"\x00\xff12", "plain.log": b"line"}
    got = {r.path.rpartition("!/")[2].rpartition(tmp_path.name + "/")[2]: (r["size"], r.kind, r.sha256) for r in store.artifact_catalog(spark, str(tmp_path), members=True).collect()}
    assert got == {n: (len(c), n.rpartition(".")[2], hashlib.sha256(c).hexdigest()) for n, c in want.items()}
    assert {r.path.rpartition("/")[2] for r in store.artifact_catalog(spark, str(tmp_path), "*.???").collect()} >= {"other.tar", "plain.log"}
