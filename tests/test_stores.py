from __future__ import annotations

import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sillage.operators import lastgood
from sillage.sinks import bundles, workbook
from sillage.sources import sqlite, xlsx
from sillage.streaming import counts, pages, tasks
from sillage.workspace import fresh, local_path, shared_folder, sweep


@pytest.fixture
def index(spark):
    folder = fresh(spark, "index")
    rows = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id") % 7).alias("name"), (F.col("id") * 0.5).alias("mass"))
    assert sqlite.write_index(rows, folder, "spectra", "k", {"schema_version": "1"}, shards=4) == 1000
    return folder


def test_index_filters_reach_sqlite_and_prune_ranges(spark, index):
    all_of_it = sqlite.read_index(spark, index, "spectra", "k", 1, rows_per_partition=50)
    assert all_of_it.count() == 1000 and all_of_it.rdd.getNumPartitions() >= 20
    some = all_of_it.filter("k >= 100 and k < 160")
    assert some.rdd.getNumPartitions() <= 4 and [r["k"] for r in some.orderBy("k").collect()] == list(range(100, 160))
    picked = all_of_it.filter("k in (5, 990) or false").select("name")
    assert sorted(r["name"] for r in picked.collect()) == ["n3", "n5"]
    assert all_of_it.filter("name = 'n3' and mass > 400").count() == sum(i % 7 == 3 and i * 0.5 > 400 for i in range(1000))
    assert "PushedFilters" in (plan := all_of_it.filter("name = 'n3'")._jdf.queryExecution().toString()) or "name" in plan
    assert all_of_it.filter("k > 5000").count() == 0 and all_of_it.filter("upper(name) = 'N3'").count() == 143


def test_index_gate(spark, index, tmp_path):
    with pytest.raises(Exception, match="schema version 1, not 2"):
        sqlite.read_index(spark, index, "spectra", "k", 2)
    with pytest.raises(Exception, match="no such table"):
        sqlite.read_index(spark, index, "other", "k", 1)
    (tmp_path / "x.sqlite").write_bytes(b"no index at all")
    with pytest.raises(Exception, match="no index"):
        sqlite.read_index(spark, str(tmp_path / "x.sqlite"), "spectra", "k", 1)
    with pytest.raises(Exception, match="no index files"):
        sqlite.read_index(spark, str(tmp_path / "empty") if (tmp_path / "empty").mkdir() is None else "", "spectra", "k", 1)


def test_index_with_null_keys_and_values(spark):
    folder = fresh(spark, "index")
    rows = [(None, "a"), (None, None), (3, None), (4, "é'\"")]
    sqlite.write_index(spark.createDataFrame(rows, "k long, name string"), folder, "t t", "k", {"schema_version": "1"}, shards=2)
    read = sqlite.read_index(spark, folder, "t t", "k", 1)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(rows, key=str)
    assert read.filter("k is null").count() == 2 and read.filter("name is not null").count() == 2 and read.filter("k = 4").first()["name"] == "é'\""


def stages(fail: int | None, ran: list[str]):
    def make(i):
        def run(tables):
            ran.append(f"s{i}")
            if i == fail:
                raise ValueError("broken")
            rows = tables[f"s{i - 1}"] if i else spark_of(tables, i)
            return rows.withColumn(f"c{i}", F.lit(i))

        return run

    return {f"s{i}": make(i) for i in range(5)}


def spark_of(tables, i):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().range(3)


def test_bundle_shows_completed_stages_and_goes_on(spark):
    folder, ran = fresh(spark, "bundle"), []
    assert bundles.open_bundle(spark, folder).status is None
    first = bundles.run_stages(spark, folder, stages(2, ran))
    assert (first.status, first.failed, list(first.tables), first.version) == ("PARTIAL_FAILED", "s2", ["s0", "s1"], 1)
    assert [tuple(r) for r in first.issues.collect()] == [("s2", "FAIL", "ValueError", "broken")]
    assert ran == ["s0", "s1", "s2"]
    ran.clear()
    second = bundles.run_stages(spark, folder, stages(None, ran))
    assert (second.status, second.failed, second.version) == ("COMPLETE", None, 2) and ran == ["s2", "s3", "s4"]
    assert second.tables["s4"].count() == 3 and second.tables["s4"].columns[-1] == "c4" and second.issues.count() == 0
    # a run that another one has overtaken is refused, and shows nothing
    with pytest.raises(RuntimeError, match="another run"):
        bundles._commit(spark, folder, {"version": 2, "status": "COMPLETE", "failed": None, "stages": {}, "issues": {}})
    assert bundles.open_bundle(spark, folder).version == 2
    ran.clear()
    assert bundles.run_stages(spark, folder, stages(None, ran)).version == 3 and ran == []


def test_pages_are_processed_once(spark):
    folder = fresh(spark, "pages")
    spark.range(40).select(F.col("id").alias("page"), F.lit("x").alias("text")).repartition(8, "page").write.parquet(f"{folder}/in")
    schema, work = "page long, text string", lambda rows: rows.withColumn("size", F.length("text"))

    def stop(batch):
        if batch == 1:
            raise RuntimeError("stop")

    with pytest.raises(StreamingQueryException):
        pages.process(spark, f"{folder}/in", f"{folder}/out", schema, work, per_batch=2, before=stop)
    left = pages.pending(spark, f"{folder}/in", f"{folder}/out", schema).count()
    assert 0 < left < 40
    spark.range(45).select(F.col("id").alias("page"), F.lit("y").alias("text")).write.mode("append").parquet(f"{folder}/in")
    done = pages.process(spark, f"{folder}/in", f"{folder}/out", schema, work, per_batch=2)
    assert sorted(r["page"] for r in done.collect()) == list(range(45))
    assert pages.pending(spark, f"{folder}/in", f"{folder}/out", schema).count() == 0


def test_tasks_expire_by_timer_or_by_the_next_event(spark):
    start = datetime(2024, 1, 1)
    rows = [
        ("a", 0, 1, "save", "t1", 1.0), ("a", 1, 2, "update", None, 2.0), ("a", 9, 3, "load", None, None),
        ("a", 10, 4, "load", None, None),  # at its very end the task is gone
        ("b", 0, 5, "load", None, None), ("b", 1, 6, "update", None, 5.0), ("b", 2, 7, "load", None, None),
        ("c", 0, 8, "save", "t2", 1.0), ("c", 3, 9, "clear", None, None), ("c", 4, 10, "load", None, None),
        ("d", 0, 11, "save", "t3", 1.0), ("d", 5, 12, "save", "t4", 2.0), ("d", 12, 13, "load", None, None),
        ("e", 0, 14, "save", "t5", 3.0),  # no event follows: a timer ends it
        ("f", 95, 15, "save", "t6", 4.0),  # still open at the end
        ("z", 100, 16, "load", None, None), (None, 1, 17, "save", "t7", 1.0),
    ]
    folder = fresh(spark, "events")
    made = spark.createDataFrame([(s, start + timedelta(minutes=m), n, a, t, p) for s, m, n, a, t, p in rows], "scope string, ts timestamp, seq long, action string, task string, payload double")
    made.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(made.schema).parquet(folder)
    out = counts.drained(tasks.task_outcomes(stream, lifetime=timedelta(minutes=10), delay="1 minute"), "append")
    zero = int(spark.range(1).select(F.unix_micros(F.lit(start).cast("timestamp"))).first()[0])
    found = sorted((r["scope"], (r["at_us"] - zero) // 60_000_000, r["outcome"], r["task"], r["payload"]) for r in out.collect())
    assert found == sorted([
        ("a", 9, "found", "t1", 2.0), ("a", 10, "expired", "t1", 2.0), ("a", 10, "absent", None, None), ("b", 0, "absent", None, None), ("b", 2, "absent", None, None),
        ("c", 4, "absent", None, None), ("d", 12, "found", "t4", 2.0), ("d", 15, "expired", "t4", 2.0), ("e", 10, "expired", "t5", 3.0), ("z", 100, "absent", None, None),
    ])


def test_last_good_and_fallback(spark):
    rows = [("k", "a", 1, True, "x", None), ("k", "a", 2, False, None, "down"), ("k", "b", 1, True, "y", None), ("m", "a", 1, False, None, None), ("m", "b", 1, None, "z", None), (None, "b", 1, True, "w", None)]
    df = spark.createDataFrame(rows, "key string, source string, at int, ok boolean, value string, error string")
    good = lastgood.last_good(df, ["key", "source"], ["at"], F.col("ok"), ["value"], "error")
    found = {(r["key"], r["source"]): (r["found"], r["value"], r["stale"], r["error"], r["attempts"]) for r in good.collect()}
    assert found == {("k", "a"): (True, "x", True, "down", 2), ("k", "b"): (True, "y", False, None, 1), ("m", "a"): (False, None, False, "Source unavailable", 1), ("m", "b"): (False, None, False, "Source unavailable", 1), (None, "b"): (True, "w", False, None, 1)}
    first = {r["key"]: (r["source"], r["value"], r["skipped"]) for r in lastgood.first_source(good, ["key"], "source", ["b", "a", "c"], ["value"]).collect()}
    assert first == {"k": ("b", "y", ""), "m": (None, None, "b,a"), None: ("b", "w", "")}
    assert lastgood.last_good(df.limit(0), ["key"], ["at"], F.col("ok"), ["value"], "error").count() == 0


def test_workbook_of_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 301)
    monkeypatch.setattr(workbook, "PIECE_ROWS", 70)
    rows = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("<é&> "), F.col("id").cast("string"))).alias("t"), (F.col("id") / 4).alias("x"))
    path = str(tmp_path / "book.xlsx")
    totals = workbook.write_parts({"All": rows.orderBy("id"), "None": rows.limit(0)}, path, fresh(spark, "book"))
    assert totals == {"All": 1000, "None": 0}
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None
    spark.dataSource.register(xlsx.Workbook)
    read = spark.read.format("workbook").load(path)
    assert {r["sheet"]: r["count"] for r in read.groupBy("sheet").count().collect()} == {"All": 301, "All 2": 301, "All 3": 301, "All 4": 101, "None": 1}
    got = [r["cells"] for r in read.filter("sheet like 'All%' and source_row > 1").withColumn("n", F.col("cells")[0].cast("int")).orderBy("n").collect()]
    assert got == [[str(i), f"<é&> {i}" if i % 3 else "NA", repr(i / 4)] for i in range(1000)]


def test_workspace(spark, tmp_path):
    folder = fresh(spark, "x")
    spark.range(3).write.parquet(folder)
    assert folder.startswith(shared_folder(spark)) and local_path("file:///a/b") == "/a/b" and local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        local_path("hdfs://host/a")
    sweep(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
