from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sillage.llm import bpe, minhash, quality, scratch
from sillage.llm.queries import TOKEN_PATTERN, TOKENIZER

SF = "/root/testdata/sf0.001"


def test_stages_decide_what_the_result_holds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF).cache()
        assert out.columns == columns
        kept.append(out)
    ids = [[r["doc_id"] for r in k.select("doc_id").collect()] for k in kept]
    good = {r["doc_id"] for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    assert set(ids[1]) == good and len(ids[1]) < len(ids[0])
    groups = minhash.near_duplicates(kept[1]).collect()
    assert set(ids[2]) == {r["component_id"] for r in groups} and len(ids[2]) < len(ids[1])
    assert sorted(ids[3]) == sorted(ids[2])
    assert kept[3].filter("text rlike 'mail[0-9]+[.]example' or n_chars <> length(text)").count() == 0
    assert set(ids[4]) <= set(ids[3])

    texts = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.load_ranks(TOKENIZER)), TOKEN_PATTERN)
    last = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(ids[4])
    for r in last:
        assert bytes(r["ids"]) == encoder.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4"))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


LONG = " ".join(f"w{i % 5000} and the" for i in range(60_000))
ROWS = [(1, "one two three four five six seven. " * 20, "en"), (1, "one two three four five six seven. " * 20, "en"), (None, "a null id with mail a@b.example", None), (2, None, "de"), (3, "", "de"), (4, LONG, "en"), (5, "call +49 30 1234567 or 4111111111111111", "de")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("theirs").alias(c) for c in ("kinds", "rate", "copies", "key", "ids", "posterior", "decoded", "component_id", "kept"))).repartition(3)


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_take_nulls_long_texts_repeats_and_clashing_columns(spark, odd, stage):
    out = corpus_pipeline.STAGES[stage][1](spark, odd, SF)
    rows = out.collect()
    assert out.columns == odd.columns and all(r["rate"] == r["key"] == r["kept"] == "theirs" for r in rows)
    ids = sorted(str(r["doc_id"]) for r in rows)
    if stage == 0:  # too few words fail the base rules; a null id stays
        assert {"2", "3", "5"}.isdisjoint(ids) and "None" in ids
    elif stage == 1:  # rows of one document stay together; texts without words are nobody's copies
        assert ids == sorted(str(k) for k, _, _ in ROWS)
    elif stage == 2:
        assert ids == sorted(str(k) for k, _, _ in ROWS)
        by = {r["doc_id"]: r for r in rows}
        assert by[2]["text"] is None and by[2]["n_chars"] is None and by[3]["text"] == "" and by[4]["text"] == LONG
        assert "4111111111111111" not in by[5]["text"] and "a@b.example" not in by[None]["text"]
    else:
        assert set(ids) <= {str(k) for k, _, _ in ROWS}


def test_token_ids_of_odd_rows(spark, odd):
    rows = corpus_pipeline.token_ids(spark, odd, SF).collect()
    assert len(rows) == len(ROWS) and {r["doc_id"]: r["n_tokens"] for r in rows}[2] == 0
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows}[4] == hashlib.sha256(LONG.encode()).hexdigest()


def test_a_failed_run_leaves_no_tables(spark, monkeypatch):
    before = list(scratch._folders)

    def broken(spark, docs, sf_dir):
        raise ValueError("broken")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", broken), corpus_pipeline.STAGES[-1]])
    with pytest.raises(ValueError, match="broken"):
        corpus_pipeline.run(spark, SF)
    left = [f for f in scratch._folders if f not in before and "/pipeline-" in f]
    fs = spark._jvm.org.apache.hadoop.fs.Path(scratch.shared_folder(spark)).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    assert not any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f)) for f in left)
