"""Checks of a released folder against its manifest: fields, sizes, digests and files that must not be there."""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.workspace import fresh, local_path

FILES = "path string, modified timestamp, bytes long"
MANIFEST = "path string, bytes long, sha256 string"

#: Names that a release must not hold, as rules with what they stand for.
FORBIDDEN = [
    ("database", r"(?i)\.(?:sqlite(?:-(?:wal|shm|journal))?|db)$"),
    ("packed database", r"(?i)\.sqlite\.(?:gz|zst)$"),
    ("packed library", r"(?i)gnps[^/]*\.(?:gz|zst)$"),
]


def _mounted(folder: str) -> str | None:
    """The folder as tasks see it; None if it is not mounted."""
    try:
        return local_path(folder).rstrip("/")
    except ValueError:
        return None


def _skipped(name: str) -> bool:
    """Names that Spark's own readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), modified and bytes of all files, however deep; no file is read.

    Tasks list the directories of one level after the other into a table, so the driver
    holds no names; of a folder that is not mounted Spark's own listing is taken, which
    the driver does hold.  Names that Spark's readers skip are left out.
    """
    root = _mounted(folder)
    if root is None:
        found = _binary(spark, folder)
        return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    kinds = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("bytes", pa.int64()), ("folder", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for below in (path for batch in batches for path in batch.column(0).to_pylist()):
            with os.scandir(f"{root}/{below}") as entries:
                named = (e for e in entries if not _skipped(e.name))
                while rows := [(f"{below}{e.name}", e.stat(), e.is_dir()) for e in itertools.islice(named, 10_000)]:
                    columns = zip(*((path, stat.st_mtime_ns // 1000, stat.st_size, inner) for path, stat, inner in rows), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.types, strict=True)], schema=kinds)

    out, level, depth = fresh(spark, "listing"), spark.createDataFrame([("",)], "path string"), 0
    while not level.isEmpty():
        level.mapInArrow(scan, "path string, modified timestamp, bytes long, folder boolean").write.parquet(f"{out}/level-{depth}")
        below = spark.read.parquet(f"{out}/level-{depth}").filter("folder").select(F.concat("path", F.lit("/")).alias("path"))
        level, depth = below.repartition(spark.sparkContext.defaultParallelism), depth + 1
    return spark.read.parquet(*(f"{out}/level-{i}" for i in range(depth))).filter("not folder").select("path", "modified", "bytes")


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    base = folder.rstrip("/").partition(":")[2].lstrip("/") if ":" in folder else folder.strip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return read.withColumn("path", F.substring_index("path", f"/{base}/", -1))


def digests(spark: SparkSession, folder: str, paths: DataFrame) -> DataFrame:
    """path and sha256 of those files that ``paths`` lists; only these are read, each hashed in its task by pieces (whole, where the folder is not mounted)."""
    root = _mounted(folder)
    if root is None:
        return _binary(spark, folder).select("path", F.sha2("content", 256).alias("sha256")).join(paths.select("path"), "path", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for path in batch.column(0).to_pylist():
                with open(f"{root}/{path}", "rb") as file:
                    sums.append(hashlib.file_digest(file, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string())], ["path", "sha256"])

    dealt = paths.select("path").repartition(4 * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(hashed, "path string, sha256 string")


def forbidden(files: DataFrame, rules: list[tuple[str, str]] = FORBIDDEN) -> DataFrame:
    """path and rule of every file that a rule forbids; a file can break several."""
    hits = F.array_compact(F.array(*(F.when(F.col("path").rlike(pattern), name) for name, pattern in rules)))
    return files.select("path", F.explode(hits).alias("rule"))


def problems(spark: SparkSession, folder: str, manifest: DataFrame, rules: list[tuple[str, str]] = FORBIDDEN) -> DataFrame:
    """(path, problem) of a released folder.

    missing: in the manifest and not there; unlisted: there and not in the manifest;
    size and digest: other than the manifest says (a digest is worked out only where the
    size is right); malformed: an entry whose digest is not 64 small hexadecimal digits
    or whose size is not positive; repeated: a path that the manifest has twice; and the
    rule that forbids a name.  A folder without files is all missing.
    """
    files = listed(spark, folder)
    entries = manifest.groupBy("path").agg(F.max("bytes").alias("want"), F.max("sha256").alias("sha256"), F.count("*").alias("times"))
    both = entries.join(files.select("path", "bytes"), "path", "full_outer")
    well = F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("want") > 0), F.lit(False))
    same = both.filter(well & (F.col("want") == F.col("bytes")))
    wrong = same.join(digests(spark, folder, same).withColumnRenamed("sha256", "found"), "path").filter("found <> sha256").select("path", F.lit("digest").alias("problem"))

    def problem(name: str, met: Column) -> Column:
        return F.when(met, name)

    known = F.col("times").isNotNull()
    told = F.array_compact(F.array(problem("missing", F.col("bytes").isNull()), problem("unlisted", ~known), problem("malformed", known & ~well), problem("repeated", F.col("times") > 1), problem("size", well & F.col("bytes").isNotNull() & (F.col("want") != F.col("bytes")))))
    return both.select("path", F.explode(told).alias("problem")).unionByName(wrong).unionByName(forbidden(files, rules).withColumnRenamed("rule", "problem"))
