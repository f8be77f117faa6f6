"""Exports: compact and detailed tables, status cells, spectra as text, stage bundles and checked publication."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def compact(df: DataFrame, key: str, medium: str, value: str, media: list[str], order: list[str]) -> DataFrame:
    """One row for each key, with the joined values and their count for each medium; the media are given, so the columns are known."""
    listed = lambda m: F.array_sort(F.collect_list(F.when(F.col(medium) == m, F.struct(*order, F.col(value).alias("_v")))))
    out = df.groupBy(key).agg(*(listed(m).alias(f"_{i}") for i, m in enumerate(media)))
    columns = []
    for i, m in enumerate(media):
        columns += [F.array_join(F.transform(f"_{i}", lambda x: x["_v"]), "; ").alias(f"{m}_values"), F.size(f"_{i}").alias(f"{m}_count")]
    return out.select(key, *columns)


def detailed(df: DataFrame, keep: list[str], items: str) -> DataFrame:
    """One row for each item; a key without items gives one row with a null item."""
    return df.select(*keep, F.explode_outer(items).alias("item"))


def status_cell(statuses: dict[str, Column]) -> Column:
    """``k:v; k:v`` in the given order, unknown ones as ``not_requested``."""
    return F.concat_ws("; ", *(F.concat(F.lit(f"{k}:"), F.coalesce(v, F.lit("not_requested"))) for k, v in statuses.items()))


def short_cell(text: Column, limit: int = 220) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit("; ")), 1, limit)


def write_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, quotes doubled."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows and an order-free digest of each stage table."""
    out = None
    for name, df in tables.items():
        row = df.select(F.xxhash64(F.to_json(F.struct("*"))).alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("digest")).select(F.lit(name).alias("table"), "rows", "digest")
        out = row if out is None else out.unionByName(row)
    return out


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def recover(spark: SparkSession, path: str) -> None:
    """Put back the table that a publication had moved away when its driver was lost before the new one was in place."""
    fs, target = _files(spark, path)
    spares = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-*")) or []
    for spare in sorted(spares, key=lambda s: s.getModificationTime(), reverse=True):
        if fs.exists(target):
            fs.delete(spare.getPath(), True)
        else:
            fs.rename(spare.getPath(), target)


def publish(spark: SparkSession, df: DataFrame, path: str, *, least: int = 1, key: list[str] | None = None) -> None:
    """Write beside ``path``, check rows and key there, and only then move into place.

    A failure leaves what was there.  A lost driver can leave it under a spare name
    between two renames; ``recover``, which every publication runs first, puts it back.
    """
    recover(spark, path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    written = spark.read.parquet(staged)
    rows = written.count()
    fs, old = _files(spark, path)
    new = _files(spark, staged)[1]
    if rows < least or (key and written.select(*key).distinct().count() != rows):
        fs.delete(new, True)
        raise ValueError(f"{path}: {rows} rows or a repeated key; not published")
    spare = _files(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    if fs.exists(old):
        fs.rename(old, spare)
    if not fs.rename(new, old):
        fs.rename(spare, old)
        raise OSError(f"{path}: the new table could not be moved into place")
    fs.delete(spare, True)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that ``df`` has rows of and leave the others."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(by).parquet(path)
