"""Index files in SQLite: a sharded writer, and a data source with filter push-down and partitions by key range.

    register(spark); spark.read.format("sqlite_index").options(path=..., table=..., key=..., schema_version=1).load()

A file has a table ``metadata`` (key, value).  Before any row is read every file must have
the expected schema version, and all files the same columns.  Each file's key range is cut
into partitions; filters on the key leave out the ranges that they rule out, and every
simple filter is part of the statement that SQLite runs.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import sqlite3
import tempfile
import urllib.parse
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from sillage.workspace import local_path

_TO_SPARK = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
_TO_SQLITE = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
_SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> contextlib.closing:
    return contextlib.closing(sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True))


def index_files(path: str) -> list[str]:
    """The index file at ``path``, or all in that folder."""
    path = local_path(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".sqlite"))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


def check_metadata(path: str, version: int | None) -> dict[str, str]:
    """A file's metadata; another schema version, or none, is an error."""
    with _open(path) as connection:
        try:
            found = dict(connection.execute("SELECT key, value FROM metadata"))
        except sqlite3.DatabaseError as error:
            raise ValueError(f"{path}: no index ({error})") from None
    if version is not None and str(found.get("schema_version")) != str(version):
        raise ValueError(f"{path}: schema version {found.get('schema_version')}, not {version}")
    return found


class SqliteIndex(ds.DataSource):
    """Options: path (a file or folder), table, key (an integer column), schema_version, rows_per_partition (50,000)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_index"

    def schema(self) -> str:
        found = index_files(self.options["path"])
        if not found:
            raise ValueError(f"{self.options['path']}: no index files")
        version = self.options.get("schema_version")
        columns = []
        for path in found:
            check_metadata(path, None if version is None else int(version))
            with _open(path) as connection:
                columns.append([(r[1], r[2].upper()) for r in connection.execute(f"PRAGMA table_info({_quoted(self.options['table'])})")])
        if not columns[0] or any(c != columns[0] for c in columns):
            raise ValueError(f"{self.options['path']}: no such table, or files with different columns")
        return ", ".join(f"`{name}` {_TO_SPARK[kind]}" for name, kind in columns[0])

    def reader(self, schema) -> IndexReader:
        return IndexReader(dict(self.options), [f.name for f in schema.fields])


class KeyRange(ds.InputPartition):
    """Keys from ``low`` to ``high`` of a file; a range that holds the file's null keys has none as ``low``."""

    def __init__(self, path: str, low: int | None, high: int | None):
        self.path, self.low, self.high = path, low, high


class IndexReader(ds.DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns
        self.where: list[str] = []
        self.values: list = []
        self.low: int | None = None
        self.high: int | None = None
        self.never_null = False

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802 - Spark's name
        """Takes comparisons with numbers and texts, lists of them, and tests for null; gives the others back to Spark."""
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: ds.Filter) -> bool:
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in self.columns:
            return False
        name, on_key = _quoted(f.attribute[0]), f.attribute[0] == self.options.get("key")
        if isinstance(f, (ds.IsNull, ds.IsNotNull)):
            self.where.append(f"{name} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL")
            self.never_null |= on_key and isinstance(f, ds.IsNotNull)
            return True
        values = list(f.value) if isinstance(f, ds.In) else [getattr(f, "value", None)]
        if not values or any(type(v) not in (int, float, str) for v in values) or not (type(f) in _SIGNS or isinstance(f, ds.In)):
            return False
        self.values += values
        self.where.append(f"{name} IN ({', '.join('?' * len(values))})" if isinstance(f, ds.In) else f"{name} {_SIGNS[type(f)]} ?")
        if on_key and all(isinstance(v, int) for v in values):
            self.never_null = True
            if not isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                low = min(values) + isinstance(f, ds.GreaterThan)
                self.low = low if self.low is None else max(self.low, low)
            if not isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                high = max(values) - isinstance(f, ds.LessThan)
                self.high = high if self.high is None else min(self.high, high)
        return True

    def partitions(self) -> list[KeyRange]:
        version, key = self.options.get("schema_version"), self.options.get("key")
        out = []
        for path in index_files(self.options["path"]):
            check_metadata(path, None if version is None else int(version))
            if key is None:
                out.append(KeyRange(path, None, None))
                continue
            with _open(path) as connection:
                rows, named, low, high = connection.execute(f"SELECT count(*), count({_quoted(key)}), min({_quoted(key)}), max({_quoted(key)}) FROM {_quoted(self.options['table'])}").fetchone()
            if rows > named and not self.never_null:
                out.append(KeyRange(path, None, None if not named else low - 1))
            if not named:
                continue
            pieces = max(1, -(-named // int(self.options.get("rows_per_partition", 50_000))))
            width = max(1, -(-(high - low + 1) // pieces))
            for start in range(low, high + 1, width):
                end = min(start + width - 1, high)
                if (self.low is None or end >= self.low) and (self.high is None or start <= self.high):
                    out.append(KeyRange(path, start, end))
        return out or [KeyRange("", 1, 0)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append(f"{_quoted(self.options['key'])} BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        elif self.options.get("key") is not None:
            where.append(f"{_quoted(self.options['key'])} IS NULL")
        chosen = ", ".join(map(_quoted, self.columns))
        with _open(partition.path) as connection:
            found = connection.execute(f"SELECT {chosen} FROM {_quoted(self.options['table'])}" + (" WHERE " + " AND ".join(where)) * bool(where), values)
            while rows := found.fetchmany(5_000):
                yield pa.RecordBatch.from_pylist([dict(zip(self.columns, r, strict=True)) for r in rows], schema=self._schema(connection))

    def _schema(self, connection: sqlite3.Connection) -> pa.Schema:
        kinds = {"INTEGER": pa.int64(), "REAL": pa.float64(), "TEXT": pa.string(), "BLOB": pa.binary()}
        declared = {r[1]: kinds[r[2].upper()] for r in connection.execute(f"PRAGMA table_info({_quoted(self.options['table'])})")}
        return pa.schema([(c, declared[c]) for c in self.columns])


def register(spark: SparkSession) -> None:
    """Make the source known, and let Spark push filters into Python sources."""
    spark.dataSource.register(SqliteIndex)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_index(spark: SparkSession, path: str, table: str, key: str, version: int, rows_per_partition: int = 50_000) -> DataFrame:
    register(spark)
    return spark.read.format("sqlite_index").options(path=path, table=table, key=key, schema_version=version, rows_per_partition=rows_per_partition).load()


def write_index(df: DataFrame, folder: str, table: str, key: str, metadata: dict[str, str], shards: int = 8) -> int:
    """Write ``df`` as ``shards`` files by ranges of ``key``, each with the metadata; returns the rows written.

    A task builds its file in its own temporary folder and moves it into place at the
    end, under its shard's name, so a task that runs again replaces what it wrote.
    """
    folder = local_path(folder)
    os.makedirs(folder, exist_ok=True)
    columns = [(name, _TO_SQLITE[kind]) for name, kind in df.dtypes]
    ddl = f"CREATE TABLE {_quoted(table)} ({', '.join(f'{_quoted(n)} {k}' for n, k in columns)})"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = TaskContext.get().partitionId(), 0
        with tempfile.TemporaryDirectory() as own:
            path = os.path.join(own, "index.sqlite")
            with contextlib.closing(sqlite3.connect(path)) as connection, connection:
                connection.execute("CREATE TABLE metadata (key TEXT PRIMARY KEY, value TEXT)")
                connection.executemany("INSERT INTO metadata VALUES (?, ?)", metadata.items())
                connection.execute(ddl)
                for batch in batches:
                    connection.executemany(f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(columns))})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
                    rows += batch.num_rows
                connection.execute(f"CREATE INDEX by_key ON {_quoted(table)} ({_quoted(key)})")
            target = os.path.join(folder, f"part-{shard:05d}.sqlite")
            shutil.copyfile(path, f"{target}.{os.getpid()}")
            os.replace(f"{target}.{os.getpid()}", target)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    counted = df.repartitionByRange(shards, key).mapInArrow(write, "rows long").collect()  # a row for each shard
    return sum(r["rows"] for r in counted)
