"""Folders that the driver and all executors share, for what operators write on the way to their results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sillage-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """The name of a new folder under the shared one; ``sweep`` or the end of the process removes it."""
    if not _folders:
        atexit.register(_last_sweep, spark)
    _folders.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _folders[-1]


def files(spark: SparkSession, path: str):
    """The file system and the path object of ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def local_path(path: str) -> str:
    """A shared folder as Python sees it; only mounted ones can be used this way."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file" and "/" not in scheme:
        raise ValueError(f"{path}: needs a folder that is mounted on the driver and all executors")
    return "/" + rest.lstrip("/") if colon and scheme == "file" else path


#: Folders that this driver has asked for.
_folders: list[str] = []


def sweep(spark: SparkSession) -> None:
    """Remove all folders so far; call it when every result that reads them is written."""
    for folder in _folders:
        fs, target = files(spark, folder)
        fs.delete(target, True)
    _folders.clear()


def _last_sweep(spark: SparkSession) -> None:
    """At the end of the process: what is left goes, if the session still lives."""
    try:
        if spark.sparkContext._jsc is not None:
            sweep(spark)
    except Exception:  # noqa: BLE001 - the session's own end must not fail for its leavings
        pass
