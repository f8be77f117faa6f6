from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from sillage.llm import search as module
from sillage.llm.queries import ORACLES, op13_search
from sillage.llm.search import build_index, search

SF = "/root/testdata/sf0.01"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(module.TERM, lower)


def brute(docs, items, k=10):
    bags = [(key, Counter(terms(t))) for key, t in docs if key is not None]
    count, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in items:
        scored = []
        for key, b in bags:
            m, score = 25 + (75 * sum(b.values()) * count) // max(total, 1), 0
            for t in terms(text):
                if b[t]:
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m))
            if score > 0:
                scored.append((-score, key))
        for rank, (score, key) in enumerate(sorted(scored)[:k], 1):
            out[item, rank] = (key, -score)
    return out


def found(df):
    rows = df.collect()
    out = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(draw, size):
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(20_000)]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([3, 20, 60, 200])))) for i in range(size)]
    return docs, words


def test_query_equals_sql(spark):
    for name in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {name} as select * from '{SF}/{name}.parquet'")
    df = op13_search(spark, SF)
    relation = duckdb.sql(ORACLES["op13_search"])
    assert df.columns == relation.columns
    rows = sorted(map(tuple, df.collect()))
    assert rows and rows == sorted(relation.fetchall())


@pytest.mark.parametrize("tiers", [(), (0.25, 0.0625), (0.6, 0.4, 0.2, 0.05)])
def test_equals_brute_force_at_any_tiers(spark, tiers):
    draw = random.Random(3)
    docs, words = corpus(draw, 400)
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 2, 5, 30])))) for i in range(25)]
    items += [(50, docs[7][1]), (51, "nowhere"), (52, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame(items, "item_id int, text string")
    assert found(search(build_index(frame, tiers=tiers), asked, items_a_pass=10)) == brute(docs, items)


def test_items_are_proven_by_the_first_tier_or_fall_through(spark, monkeypatch):
    draw = random.Random(4)
    docs, _ = corpus(draw, 300)
    docs += [(1000 + i, "needle thread " + "w1 " * (3 + i)) for i in range(20)]
    items = [(1, "needle thread w1"), (2, "w1 w2 w3 w1"), (3, "w1 w4")]
    depths = []
    real = module._scorer

    def spy(queries, residual, k, last):
        depths.append((len(residual), last))
        return real(queries, residual, k, last)

    monkeypatch.setattr(module, "_scorer", spy)
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    # rare words lie in the first tier, common ones below it
    tiers = {(t, r["tier"]) for r in index.cells.collect() for t in r["terms"] if t in ("needle", "w1")}
    assert ("needle", 1) in tiers and ("needle", 3) not in tiers and ("w1", 1) not in tiers and ("w1", 3) in tiers
    needle = spark.createDataFrame(items[:1], "item_id int, text string")
    assert found(search(index, needle)) == brute(docs, items[:1])
    assert [last for _, last in depths] == [False, True]  # proven after one tier, then completed
    depths.clear()
    assert found(search(index, spark.createDataFrame(items[1:], "item_id int, text string"))) == brute(docs, items[1:])
    assert [last for _, last in depths] == [False, False, True]


def test_each_cell_is_read_once_by_few_tasks(spark, monkeypatch):
    draw = random.Random(5)
    docs, words = corpus(draw, 300)
    items = [(i, " ".join(draw.choice(words) for _ in range(60))) for i in range(5)]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    assert {r["tier"] for r in index.cells.select("tier").collect()} == {1, 2, 3}
    rows, tasks, real = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), module._picked

    def counting(wanted):
        run = real(wanted)

        def counted(batches):
            tasks.add(1)
            for batch in batches:
                rows.add(batch.num_rows)
                yield from run(iter([batch]))

        return counted

    monkeypatch.setattr(module, "_picked", counting)
    monkeypatch.setattr(module, "CELLS_A_TASK", 10_000, raising=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # a task for each file
    try:
        assert found(search(index, spark.createDataFrame(items, "item_id int, text string"))) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    held = {t for _, text in docs for t in terms(text)}
    buckets = {module._place(t.encode(), module.BUCKETS) for _, text in items for t in terms(text) if t in held}
    # no item is proven by the upper tiers, so all of its terms' buckets are read
    assert rows.value == sum(r["bucket"] in buckets for r in index.cells.select("bucket").collect())
    assert tasks.value <= 3 * spark.sparkContext.defaultParallelism


def test_blocks_without_upper_postings_keep_items_unproven(spark):
    # ten short documents lead by the first tier alone; the better ones have nothing but common words, in a block of their own
    common = [(100 + i, "c1 c2 c3 c4 c5 c6 " * 2) for i in range(12)]
    docs = [(i, "rare " + "f " * 40) for i in range(10)] + common + [(200 + i, f"c{1 + i % 6} c{1 + (i + 1) % 6} u{i}") for i in range(40)]
    frame = spark.createDataFrame(docs[:10], "doc_id long, text string").coalesce(1).unionByName(spark.createDataFrame(docs[10:], "doc_id long, text string").coalesce(1))
    items = [(1, "rare c1 c2 c3 c4 c5 c6")]
    asked = spark.createDataFrame(items, "item_id int, text string")
    for tiers in ((0.25, 0.0625), (0.2,), (0.1,), (0.05,)):
        assert found(search(build_index(frame, tiers=tiers), asked)) == brute(docs, items)


def test_edges(spark):
    long = "x " * 400_000
    docs = [(1, None), (2, ""), (3, " .,"), (4, "É é"), (5, "Kelvin K"), (None, "a b"), (6, "a b"), (6, "a b"), (7, "a"), (8, long + "a")]
    items = [(1, "a"), (2, None), (3, "é KELVIN"), (3, "b"), (None, "a"), (4, "a a b")]
    frame = spark.createDataFrame([(*r, 0, "y") for r in docs], "doc_id long, text string, block int, term string")
    asked = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, item int")
    expected = brute(docs, [(1, "a"), (3, "é KELVIN"), (4, "a a b")])
    assert found(search(build_index(frame), asked)) == expected
    assert search(build_index(frame.limit(0)), asked).count() == 0 and search(build_index(frame), asked.limit(0)).count() == 0
