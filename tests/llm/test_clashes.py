from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sillage.llm import bpe, chat, langid, minhash, mixing, pii, quality, sketch, urls, warc
from sillage.llm.queries import TOKEN_PATTERN, TOKENIZER, URL_RULES, WEIGHTS
from sillage.llm.scratch import Scratch

#: Every column name that an operator uses inside or returns.
INSIDE = ["_key", "_gone", "__rate", "__copies", "__copy", "__key", "__url", "__pii", "_domain", "_place", "_order", "_sent", "key", "domain", "rep", "component", "shingle", "rank", "df", "n", "size", "bands", "set_key", "n_shingles", "component_id", "kept", "n_words", "anomaly", "base_failed", "quality", "posterior", "rate", "copies", "n_tokens", "host", "path", "rule", "verdict", "token", "payload", "digest", "sha", "holder", "refers_to", "ids", "decoded", "sketch", "next_text", "own", "lang_pred", "score", "held_out", "place", "bucket", "pii_kinds", "formatted", "loss_mask", "piece", "head", "body", "end", "layout", "input", "prompt", "output", "a.b"]
LONG = " ".join(f"w{i % 5000}" for i in range(180_000))
DOCS = [(1, "one two three four five six " * 20, "en"), (1, "one two three four five six " * 20, "en"), (None, "null id", None), (2, None, "de"), (3, "", "de"), (4, LONG, "en"), (5, "der die das und mail a@b.example 4111111111111111", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    return df.select("*", *(F.lit("theirs").alias(c) for c in INSIDE)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 1), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").withColumn("_key", F.lit(1)).withColumn("domain", F.lit("x")).withColumn("key", F.lit(0))


def whole(df, docs, changed=()):
    """Every row came back with the caller's columns as they were."""
    assert df.columns[: len(docs.columns)] == docs.columns or set(df.columns) >= set(docs.columns)
    for r in df.collect():
        assert all(r[c] == "theirs" for c in INSIDE if c not in changed)


def test_quality(docs, labels):
    assert quality.judge(docs, labels).count() == len(DOCS)
    whole(quality.keep_good(docs, labels), docs)
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.keep_good(docs.limit(0), labels).count() == 0


def test_minhash(docs):
    assert minhash.near_duplicates(docs).count() == len(DOCS)
    whole(minhash.deduplicate(docs), docs)
    assert minhash.deduplicate(docs.limit(0)).count() == 0


def test_mixing(docs, labels):
    assert mixing.mixing_rates(docs, labels, WEIGHTS).count() == len(DOCS)
    whole(mixing.mix(docs, labels, {"clean": 1.0}), docs)
    assert mixing.mix(docs.limit(0), labels, WEIGHTS).count() == 0


def test_bpe(docs, spark):
    out = bpe.encode(docs, bpe.Vocabulary(bpe.load_ranks(TOKENIZER)), TOKEN_PATTERN, key="doc_id", decoded=True).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"]).decode()) for r in out) == sorted((k or -1, t or "") for k, t, _ in DOCS)


def test_pii(docs):
    out = pii.mask(docs, "k")
    assert out.count() == len(DOCS)
    whole(out, docs, ("pii_kinds",))
    assert pii.mask(docs.limit(0), "k").count() == 0


def test_language(docs):
    assert langid.identify(docs, langid.fit_language_model(docs)).count() == len(DOCS)


def test_sketch(docs):
    assert sketch.fingerprints(docs).count() == len(DOCS)
    out = sketch.with_next(docs, parts=3).collect()
    assert len(out) == len(DOCS) and sorted(str(r["text"]) for r in out) == sorted(str(r["next_text"]) for r in out)


def test_urls(spark, docs):
    rows = [(1, "http://www.example.com/en/x"), (1, "http://www.example.com/en/x"), (None, None), (2, ""), (3, "http://" + "a" * 1_000_000 + ".net/fr/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *(F.lit("theirs").alias(c) for c in INSIDE))
    out = urls.filter_urls(pages, [*URL_RULES, *urls.UNWANTED])
    assert out.count() == len(rows)
    whole(out, pages, ("host", "path", "rule", "verdict"))


def test_warc(spark):
    odd = "http://a/%0A%25?\n\x7f b%20 "
    rows = [(1, odd, "x"), (2, None, None), (3, "u", "x" * 1_000_000), (None, "n", "x"), (3, "u", "x" * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("theirs").alias(c) for c in INSIDE))
    read = warc.read_archives(warc.archive(pages, Scratch(spark, "warc-test").folder), payload=True).collect()
    assert len(read) == len(rows)
    assert {(r["key"], r["url"]) for r in read} == {(k, u) for k, u, _ in rows}
    assert {r["key"]: r["record_type"] for r in read} == {1: "response", 2: "response", 3: "response", None: "revisit"}


def test_chat(spark):
    rows = [(1, 0, "user", LONG), (1, 0, "user", LONG), (1, None, None, None), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit("theirs").alias(c) for c in INSIDE))
    read = {r["key"]: r["turns"] for r in chat.parse_chats(chat.format_chats(chat.turns_from_table(df, key="conv_id"))).collect()}
    assert [(t["role"], t["text"]) for t in read[1]] == [("", ""), ("user", LONG), ("user", LONG)] and len(read[None]) == 1
