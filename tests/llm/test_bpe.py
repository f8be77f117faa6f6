from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sillage.llm import bpe
from sillage.llm.queries import TOKEN_PATTERN, TOKENIZER, op2_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    ranks = bpe.load_ranks(public_tokenizers.path(request.param))
    return bpe.Encoder(bpe.Vocabulary(ranks), TOKEN_PATTERN), tiktoken.Encoding("own", pat_str=TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_equals_the_library_on_random_texts(both):
    ours, library = both
    draw = random.Random(3)
    parts = ["a", "b", "ab", " ", "  ", "\n", "é", "ß", "1", "23", "'s", "\u3000", "😀", "the", "ing", "tion", "\t", "\x1c", "\x85", "\u00a0", "ñ", "中", "-", "=="]
    for i in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(60)))
        if i % 3 == 0:
            text = "".join(draw.choice("aeinrst ") for _ in range(draw.randrange(200)))
        assert ours.encode(text) == packed(library.encode_ordinary(text))
        assert ours.decode(ours.encode(text)).decode() == text


def test_long_runs_and_block_borders(both):
    ours, library = both
    for text in ("a" * 100_000, "ab " * 60_000, " \n\t " * 40_000, "word\u3000" * 30_000, ("x" * 70_000 + "  y") * 3):
        assert ours.encode(text) == packed(library.encode_ordinary(text))


def test_pairs_fit_as_merging_says(both):
    ours, library = both
    draw = random.Random(5)
    size = len(ours.table)
    for _ in range(20_000):
        a, b = draw.randrange(size), draw.randrange(size)
        data = ours.table[a] + ours.table[b]
        if data not in ours.ranks:
            assert ours.fit(a, b) == (library._core_bpe.encode_single_piece(data) == [a, b])


def test_query_equals_the_library(spark):
    ranks = bpe.load_ranks(TOKENIZER)
    library = tiktoken.Encoding("own", pat_str=TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in op2_bpe(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(texts)
    for row in texts:
        ids = library.encode_ordinary(row["text"] or "")
        got = found[row["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()


def test_edges(spark):
    vocabulary = bpe.Vocabulary(bpe.load_ranks(TOKENIZER))
    rows = [(1, None, "x"), (2, "", "x"), (None, "hello world", "x"), (2, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, vocabulary, TOKEN_PATTERN, key="doc_id")
    assert sorted(len(r["ids"]) for r in out.collect()) == [0, 0, 12, 12]
    assert sorted(map(bytes, (r["decoded"] for r in bpe.decode(out, vocabulary, TOKEN_PATTERN, key="doc_id").collect()))) == [b"", b"", b"hello world", b"hello world"]
    longs = out.select(bpe.unpack("ids").alias("x"), "ids").collect()
    assert all(list(np.frombuffer(r["ids"], "<u4")) == r["x"] for r in longs)
    assert bpe.encode(df.limit(0), vocabulary, TOKEN_PATTERN, key="doc_id").count() == 0
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})
    assert out.filter(F.col("ids").isNull()).count() == 0
