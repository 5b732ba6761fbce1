"""Reading and writing of tables, logs, manifests and artifacts."""

from __future__ import annotations

import hashlib
import io
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, written

#: Files of this many bytes or more are not read for their checksum.
MOST_HASHED = 64 * 1024 * 1024
#: The ending of a path.
KIND = r"\.([A-Za-z0-9]+)$"
MANIFEST = "deterministic array<struct<tag string, scenario string, fault string, seed bigint, pcap string, log string, summary struct<result struct<ok boolean>, transitions array<string>>>>, flake array<struct<tag string, fault string, seed bigint, injected boolean, fired boolean, pcap string, log string>>"


def scan_store(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table of a fixed schema; unused columns and filtered rows are not read."""
    return spark.read.schema(schema).parquet(path)


def read_log_text(spark: SparkSession, glob: str) -> DataFrame:
    """path, line_no (from 1), raw of the lines that aren't blank, in files or in all that lies below folders; invalid bytes are replaced. Many folders are better given by their top, which tasks list, than by a pattern, which the driver looks through.

    Files are read in splits that end at line ends, so a file of any size is many tasks. A first scan counts the lines of each split;
    a line's number is that of the lines in the splits of its file before its own, plus its place in the split, which
    is how far its row is from the split's first row. Both scans cut the files alike, as they read the same list of files under the same settings: files must
    not change meanwhile.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    splits = written(lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n")), "splits")
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("path", "block", (before - F.col("first") + 1).alias("shift"))
    return lines.join(F.broadcast(starts), ["path", "block"]).select("path", (F.col("id") + F.col("shift")).alias("line_no"), F.make_valid_utf8("value").alias("raw")).where(F.col("raw").rlike(r"\S"))


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """kind, tag, scenario, fault, fired, ok, transitions: a row for each run of corpus manifests, one to a file, or to a line."""
    m = spark.read.schema(MANIFEST).json(path, multiLine=not lines)
    fixed = m.select(F.inline("deterministic")).select(F.lit("deterministic").alias("kind"), "tag", "scenario", "fault", F.lit(None).cast("boolean").alias("fired"), F.col("summary.result.ok").alias("ok"), F.col("summary.transitions").alias("transitions"))
    flaky = m.select(F.inline("flake")).select(F.lit("flake").alias("kind"), "tag", F.lit(None).cast("string").alias("scenario"), "fault", "fired", F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("array<string>").alias("transitions"))
    return fixed.unionByName(flaky)


def decode_json_columns(df: DataFrame, **schemas: str) -> DataFrame:
    """JSON text columns as typed ones."""
    return df.withColumns({c: F.from_json(c, s) for c, s in schemas.items()})


def artifact_catalog(spark: SparkSession, folder: str, pattern: str = "*", members: bool = False) -> DataFrame:
    """path, size, kind, sha256 (null for large files, whose content isn't read) of the files below folder. Empty files are left out, as Spark's scans of files do. With members, those of tar archives (archive!/name) are told instead of the archive, if it isn't large; archives are known by their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    kind = F.lower(F.regexp_extract("path", KIND, 1))
    small = files.where(F.col("length") < MOST_HASHED)
    large = files.where(F.col("length") >= MOST_HASHED).select("path", F.col("length").alias("size"), kind.alias("kind"), F.lit(None).cast("string").alias("sha256"))
    is_tar = F.substring("content", 258, 5) == F.lit(b"ustar")
    own = small.where(~is_tar) if members else small
    told = own.select("path", F.col("length").alias("size"), kind.alias("kind"), F.sha2("content", 256).alias("sha256")).unionByName(large)
    if not members:
        return told
    ship(spark)
    inside = small.where(is_tar).select("path", "content").mapInArrow(tar_members, "path string, size long, sha256 string")
    return told.unionByName(inside.select("path", "size", kind.alias("kind"), "sha256"))


def tar_members(batches):
    """path, size and sha256 of the members of archives (path, content)."""
    for b in batches:
        rows = []
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            with tarfile.open(fileobj=io.BytesIO(content.as_py()), ignore_zeros=True) as archive:
                rows += [(f"{path}!/{m.name}", m.size, hashlib.sha256(archive.extractfile(m).read()).hexdigest()) for m in archive if m.isfile() and m.size]
        yield pa.RecordBatch.from_pydict({"path": pa.array([r[0] for r in rows], pa.string()), "size": pa.array([r[1] for r in rows], pa.int64()), "sha256": pa.array([r[2] for r in rows], pa.string())})


def write_tars(files: DataFrame, path: str, n: int) -> None:
    """files (name, content: text) as members of n tar archives, each written by one task; blocks of zeros may lie between members (tar -i)."""
    ship(files.sparkSession)

    def as_members(batches):
        for b in batches:
            out = []
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                info, text = tarfile.TarInfo(name), content.encode()
                info.size = len(text)
                # the last zero is the end of the line, which Spark writes
                out.append(info.tobuf(tarfile.GNU_FORMAT) + text + bytes((-len(text) % 512 or 512) - 1))
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary()).cast(pa.string())})

    files.select("name", "content").repartition(n, "name").mapInArrow(as_members, "value string").write.option("lineSep", "\0").text(path)


def list_captures(spark: SparkSession, folder: str, contains: str = "", limit: int = 100, pattern: str = "*.pcap") -> DataFrame:
    """name, size of the first captures, files or folders of files below folder, whose stem contains a text, in any case; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    top = folder.rstrip("/").rpartition("/")[2]
    name = F.element_at(F.split(F.substring_index("path", f"/{top}/", -1), "/"), 1)
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return files.where(stem.contains(contains.lower())).groupBy(name.alias("name")).agg(F.sum("length").alias("size")).orderBy("name").limit(limit)


def append_facts(df: DataFrame, path: str, *partitions: str) -> None:
    """Appends rows to a Parquet table."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)
