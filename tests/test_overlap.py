"""The overlap merge over whole texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sillage.operators import rollup
from sillage.plans import registry

SF = "/root/testdata/sf0.001"


def folded(parts):
    state = ""
    for nxt in parts:
        if state == "":
            state = nxt
        elif nxt in state:
            continue
        elif state in nxt:
            state = nxt
        else:
            size = next((n for n in range(min(220, len(state), len(nxt)), 34, -1) if state[-n:] == nxt[:n]), None)
            state = f"{state}\n{nxt}" if size is None else state + nxt[size:]
    return state


def windows(text):
    return [text[at : at + 300] for at in range(0, max(len(text) - 100, 1), 200)]


def test_whole_texts_are_merged(spark, tmp_path):
    rng = random.Random(3)
    plain = "".join(rng.choice("abcdefgh ö") for _ in range(3017))
    texts = [plain, plain[:501], plain[:500], plain[:301], plain[:300], "short", "", None, "ab" * 700, "x" * 900, ("the same line\n" * 60) + plain]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.queries()["e21_overlap_merge"](spark, str(tmp_path)).collect()}
    assert [got[i]["whole"] for i in range(len(texts))] == texts
    assert [got[i]["merged"] for i in range(8)] == texts[:8]
    assert [got[i]["merged"] for i in range(8, len(texts))] == [folded(windows(t)) for t in texts[8:]]
    documents = registry.table(spark, SF, "documents")
    made = registry.queries()["e21_overlap_merge"](spark, SF).collect()
    assert len(made) == documents.count()
    assert {r["doc_id"]: r["merged"] for r in made} == {r["doc_id"]: folded(windows(r["text"])) for r in documents.collect()}


def test_overlaps_are_the_longest(spark):
    rng = random.Random(5)
    lists = [[("ab" * rng.randint(0, 200) + "c" * rng.randint(0, 3) + "ab" * rng.randint(0, 120))[: rng.randint(0, 400)] for _ in range(4)] for _ in range(200)]
    made = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, parts array<string>").select("i", rollup.merge_overlap(F.col("parts")).alias("m")).collect()
    assert {r["i"]: r["m"] for r in made} == {i: folded(x) for i, x in enumerate(lists)}
