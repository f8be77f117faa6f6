"""Written intermediate tables that survive lost executors.

Iterative operators cut their lineage by writing Parquet under the folder that the
cluster names in ``spark.checkpoint.dir`` and reading it back.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master without one, a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sillage-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def private(name: str) -> str:
    """A column name that no table of a caller has."""
    return f"_{name}_{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Spark's setting to remove a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A folder of its own for one run of one operator.

    Tables that a lazy result still reads stay until ``sweep`` or the end of the
    session's process; an operator drops what its result doesn't read.  A failed write
    drops the whole folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        if not _folders:
            atexit.register(_last_sweep, spark)
        _folders.append(self.folder)

    def save(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Write ``df``, in folders by the columns ``by`` (its last ones) if given, and return the written table."""
        self._count += 1
        path = f"{self.folder}/{self._count:03d}"
        schema = df.schema
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            # nothing reads the shuffles of a written table again
            self.spark.conf.set(_CLEANUP, "true")
            df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        except BaseException:
            self.drop()
            raise
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    def only(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as the one table that stays, and drop the tables that it was made from."""
        kept = Scratch(self.spark, self.folder.rpartition("/")[2].rpartition("-")[0]).save(df)
        self.drop()
        return kept

    def drop(self) -> None:
        """Delete the folder; no result may read it any more."""
        _delete(self.spark, self.folder)
        if self.folder in _folders:
            _folders.remove(self.folder)


#: Folders that this driver's operators have written to.
_folders: list[str] = []


def sweep(spark: SparkSession) -> None:
    """Delete all scratch tables and archives so far; call it when every result that reads them is written."""
    for folder in _folders:
        _delete(spark, folder)
    _folders.clear()


def _last_sweep(spark: SparkSession) -> None:
    """At the end of the process: what is left goes, if the session still lives."""
    try:
        if spark.sparkContext._jsc is not None:
            sweep(spark)
    except Exception:  # noqa: BLE001 - the session's own end must not fail for its leavings
        pass


#: Rows of 8-byte ids up to which a join side is broadcast (about 8 MB); beyond, it is shuffled.
BROADCAST_IDS = 1_000_000


def small(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (a written table of narrow rows), marked for broadcast if its count is within ``limit``."""
    return F.broadcast(ids) if ids.count() <= limit else ids
