"""What went wrong only on larger tables or odd rows."""

from __future__ import annotations

import hashlib
import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sillage.operators import assay, counters, ordered, pageindex, thresholds
from sillage.plans import registry, stores
from sillage.sinks import workbook
from sillage.sources import adapters, releases
from sillage.streaming import tasks


def test_assays_of_a_long_answer_take_time_in_proportion(spark):
    """The payload was read again for each of its rows: 6,000 of them took over 100 s."""
    rows = [{"Cell": [str(i % 5000) if i % 3 else "", "x"]} for i in range(6000)]
    answers = spark.createDataFrame([("k", json.dumps({"Table": {"Columns": {"Column": ["AID", "Name"]}, "Row": rows}})), ("none", "{}")], "key string, payload string")
    began = time.monotonic()
    found = {r["key"]: r for r in adapters.assays(answers).filter("total >= 0").collect()}
    assert found["k"]["total"] == 4000 and len(found["k"]["assays"]) == 100 and found["k"]["assays"][0] == {"AID": "1", "Name": "x"}
    assert found["none"]["total"] == 0 and found["none"]["status"] == "invalid_response"
    assert time.monotonic() - began < 30


def test_html_record_decodes_what_its_sql_decodes(spark, tmp_path):
    pages = [(1, '<html lang=" EN"><title>&nbsp;a &quot;b&quot; &amp;amp; c </title><h9>no</h9>'), (2, "<title>\n x\n</title>"), (3, "<title> </title>"), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: (r["title"], r["lang"]) for r in registry.queries()["a14_html_record"](spark, str(tmp_path)).collect()}
    assert found == {1: ("a &quot;b&quot; &amp; c", " EN"), 2: ("\n x\n", None), 3: (None, None), 4: (None, None)}


def test_a_cache_row_of_the_same_second_can_be_from_the_future(spark):
    rows = [(1, "2024-01-20 00:00:00.5"), (2, "2024-01-20 00:00:00"), (3, "2024-01-19 00:00:00"), (4, "2024-01-18 23:59:59.9"), (5, None)]
    cache = spark.createDataFrame(rows, "id int, at string").select("id", F.col("at").cast("timestamp_ntz").alias("stored_at"), F.lit("a").alias("source"), F.lit("ok").alias("status"))
    kept = counters.fresh(cache, {"a": 1}, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]


def test_a_report_longer_than_a_sheet_is_read_back_whole(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    query = registry.queries()["b15_batch_report"]
    whole = sorted(map(tuple, query(spark, sf).collect()))
    monkeypatch.setattr(workbook, "SHEET_ROWS", 31)
    names = [n for n, _, _ in workbook.placed({"Parts": 61, "Parts 2": 30, "None": 0})]
    assert names == ["Parts", "Parts 2", "Parts 3", "Parts 2_2", "None"]
    assert len(whole) > 300 and sorted(map(tuple, query(spark, sf).collect())) == whole


def test_a_release_is_listed_and_hashed_by_tasks(spark, tmp_path, monkeypatch):
    for name, said in (("a.txt", "1"), ("d/b.txt", "22"), ("d/e/c.db", "333"), ("d/_no", "4"), (".no/x", "5")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(said)
    (tmp_path / "empty").mkdir()
    monkeypatch.setattr(releases, "_binary", lambda *_: pytest.fail("the driver lists the files"))
    folder = f"file://{tmp_path}"
    assert {(r["path"], r["bytes"]) for r in releases.listed(spark, folder).collect()} == {("a.txt", 1), ("d/b.txt", 2), ("d/e/c.db", 3)}
    sums = {n: hashlib.sha256(t).hexdigest() for n, t in (("a.txt", b"1"), ("d/b.txt", b"23"))}
    manifest = spark.createDataFrame([("a.txt", 1, sums["a.txt"]), ("d/b.txt", 2, sums["d/b.txt"])], releases.MANIFEST)
    found = {tuple(r) for r in releases.problems(spark, folder, manifest).collect()}
    assert found == {("d/b.txt", "digest"), ("d/e/c.db", "unlisted"), ("d/e/c.db", "database")}


def test_events_are_carried_over_runs_of_pages(spark):
    pages = [-(1 << 40), -70_000, -1, 0, 5, 65_535, 65_536, 200_000, 1 << 33, (1 << 33) + 1, 1 << 52]
    rows = [(book, page, block, f"{book}{page}" if (page + block) % 3 == 1 else None) for book in ("a", "b") for page in pages for block in (1, 2)]
    df = spark.createDataFrame(rows, "book string, page long, block long, said string")
    for made, books in ((df, ("a", "b")), (df.filter("book = 'a'").drop("book"), (None,))):
        got = {(r.asDict().get("book"), r["page"], r["block"]): r["e"] for r in pageindex.over_pages(made, "page", "block", F.col("said"), "e", own_row=False).collect()}
        want = {}
        for book in books:
            held = None
            for b, page, block, said in rows:
                if b == (book or "a"):
                    want[book, page, block], held = held, said or held
        assert got == want
    plan = pageindex.over_pages(df.drop("book"), "page", "block", F.col("said"), "e", own_row=False)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [last(_last" in line]
    assert len(windows) == 4 and sum("_part" in line for line in windows) >= 3


def test_numbers_go_on_over_runs(spark):
    places = [None, -(1 << 33), -1, 0, 1, 65_535, 65_536, 70_000, 1 << 40]
    rows = [(key, at, i) for key in ("a", None) for at in places for i in range(3)]
    df = spark.createDataFrame(rows, "key string, at long, i int").repartition(5)
    got = {(r["key"], r["at"], r["i"]): r["n"] for r in ordered.numbered(df, ["key"], ["at", "i"], "n").collect()}
    assert got == {row: n % 27 + 1 for n, row in enumerate(rows)}
    plan = ordered.numbered(df, ["key"], ["at", "i"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line for line in plan.splitlines() if "row_number" in line and "Window [" in line)


def test_hits_read_their_rows_once(spark):
    """Each of the seven tables behind records and issues read all rows again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    cells = [["[MC Peak Table]"], ["Peak#", "Area", "Ret. Index"], ["1", "9", "1000"], ["1", "8", "1001"], ["2", "7", "1002"], ["[MS Similarity Search Results for Spectrum Process Table]"]]
    cells += [["Spectrum#", "Hit #", "CAS #", "Name", "Name"], ["1", "1", "a", "n", "m"], ["1", "1", "b", "n", "m"], ["2", "2", "c", "n", "m"]]
    rows = [("s", i, c) for i, c in enumerate(cells)] + [("empty", 1, ["x"])]
    made = spark.createDataFrame(rows, "sheet string, source_row int, cells array<string>").mapInArrow(counted, "sheet string, source_row int, cells array<string>")
    records, issues = assay.hits(made)
    assert sorted((r["peak"], r["cas"], r["name"], r["area"], r["peak_row"], r["search_row"]) for r in records.collect()) == [(1, "a", "n", "8", 3, 7), (1, "a", "n", "9", 2, 7)]
    assert {(r["sheet"], r["code"], r["about"]) for r in issues.collect()} == {
        ("s", "HIT1_NOT_FOUND", "2"),
        ("s", "REVIEW_DUPLICATE_PEAK", "1"),
        ("s", "REVIEW_DUPLICATE_HIT1", "1"),
        ("empty", "FAIL_MISSING_PEAK_TABLE", None),
        ("empty", "FAIL_MISSING_SEARCH_RESULTS", None),
    }
    assert seen.value == len(rows)


def test_a_page_file_that_comes_twice_is_filtered_by_many_tasks(spark, tmp_path):
    docs = spark.range(0, 1200, numPartitions=6).select(F.col("id").alias("page"), F.spark_partition_id().cast("string").alias("text"))
    stores._deliver(docs, str(tmp_path / "source"), 12)
    twice = spark.read.parquet(str(tmp_path / "source")).groupBy("page").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts")).filter("n > 1").collect()
    assert sorted(r["page"] for r in twice) == list(range(5, 1200, 12))
    assert all(r["texts"] == 1 for r in twice)  # filtered where they lay, not all in one task
    assert stores._page_files(1) == 12 and stores._page_files(6 << 30) == 192


def test_a_task_store_writes_state_once_for_a_scope():
    calls = []

    class State:
        held = ("old", 1.0, 500)
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = lambda self, value: calls.append(("update", value))
        clear = lambda self: calls.append(("clear",))

    class Handle:
        deleteTimer = lambda self, at: calls.append(("delete", at))  # noqa: E731, N815
        registerTimer = lambda self, at: calls.append(("register", at))  # noqa: E731, N815

    store = tasks.TaskStore(1_000_000)
    store.task, store.handle = State(), Handle()
    rows = [(9_000, 3, "update", "", 7.0), (1_000, 1, "load", "", 0.0), (2_000, 2, "save", "a", 2.0), (9_500, 4, "clear", "", 0.0), (9_600, 5, "save", "b", 3.0), (9_700, 6, "load", "", 0.0)]
    frame = pd.DataFrame(rows, columns=["us", "seq", "action", "task", "payload"])
    (out,) = store.handleInputRows(("k",), iter([frame]), None)
    assert out["outcome"].tolist() == ["expired", "absent", "found"] and out["task"].tolist()[::2] == ["old", "b"]
    assert calls == [("delete", 1), ("update", ("b", 3.0, 1_009_600)), ("register", 1_010)]


def _belongs(hit, t):
    named = t["subject"] in (hit["names"] or []) and (bool(t["verified"]) or hit["cas"] is None)
    chunked = hit["cas"] is None and (not hit["chunks"] or t["block"] is not None and t["block"] in hit["chunks"])
    same = hit["cas"] is not None and hit["cas"] == t["cas"]
    return t["page"] is not None and t["page"] in hit["pages"] and (same or named or chunked) if hit["pages"] else same


@pytest.mark.parametrize("unpaged", [True, False])
def test_thresholds_of_hits_are_shuffled_by_page_alone(spark, unpaged):
    """Thresholds were shuffled by number too, though each hit had pages, and the pairs a third time."""
    hits = [(i % 40, [None, [], [i % 7, i % 7 + 1], [i % 7, i % 7], [9, None]][i % 5], [None, [], [i % 3], [None, 1]][i % 4], None if i % 3 else i % 4, [None, ["R"], ["R", "A"]][i % 3 if i % 2 else 1]) for i in range(60)]
    hits = [h for h in hits if unpaged or h[1]]
    lines = [(i % 9 or None, i % 4 or None, i % 2, i % 4 if i % 5 else None, [None, "R", "N"][i % 3], [None, True, False][i % 7 % 3]) for i in range(120)]
    left = spark.createDataFrame(hits, "hit int, pages array<int>, chunks array<int>, cas int, names array<string>")
    right = spark.createDataFrame(lines, "page int, block int, n int, cas int, subject string, verified boolean")
    found = thresholds.of_hits(left, right, ["page", "block", "n"])
    pairs = {(h["hit"], t["page"], t["block"], t["n"]) for h in left.collect() for t in right.collect() if _belongs(h, t)}
    order = lambda row: str(tuple(row))
    assert len(pairs) > 50 and sorted(map(tuple, found.collect()), key=order) == sorted(pairs, key=order)
    named = thresholds.of_hits(left, right.withColumn("id", F.col("n")))
    assert sorted(map(tuple, named.collect())) == sorted({(p[0], p[3]) for p in pairs})
    if not unpaged:
        plan = found._jdf.queryExecution().executedPlan().toString()
        plan = plan.partition("Initial Plan")[2] or plan
        assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(page") == 2
