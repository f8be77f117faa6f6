"""Pages processed once, however often the work is stopped: a file stream whose results are idempotent by page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.workspace import files


def process(spark: SparkSession, source: str, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], *, page: str = "page", per_batch: int = 8, before: Callable[[int], None] | None = None) -> DataFrame:
    """Apply ``work`` to every page in the Parquet files under ``source`` that has no result yet, and return all results.

    The stream's checkpoint remembers which files are done, ``per_batch`` of them at a
    time.  A batch is written under its number, so one that was stopped half-way
    replaces itself when it is run again; pages that an earlier batch has results of,
    from a file that was delivered twice, are left out, and so are repeats in a batch.
    ``before`` is called with a batch's number once its rows are written and not yet
    marked as done (a stop there is the hardest one).
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        fs, at = files(spark, f"{folder}/pages")
        found = work(batch.dropDuplicates([page]))
        earlier = [s.getPath().toString() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName() < f"batch-{number:08d}"]
        if earlier:
            done = spark.read.parquet(*earlier).select(page)
            found = found.join(done, page, "left_anti")
        found.write.mode("overwrite").parquet(f"{folder}/pages/batch-{number:08d}")
        if before is not None:
            before(number)

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    fs, at = files(spark, f"{folder}/pages")
    if not fs.exists(at):
        return work(spark.createDataFrame([], schema)).limit(0)
    made = spark.read.parquet(f"{folder}/pages/batch-*")
    return made.select(*made.columns)


def pending(spark: SparkSession, source: str, folder: str, schema: str, page: str = "page") -> DataFrame:
    """Pages of the source that have no result yet."""
    wanted = spark.read.schema(schema).parquet(source).select(page).distinct()
    fs, at = files(spark, f"{folder}/pages")
    if not fs.exists(at):
        return wanted
    return wanted.join(spark.read.parquet(f"{folder}/pages/batch-*").select(F.col(page)), page, "left_anti")
