from __future__ import annotations

import hashlib
import random
import re
import string

import pytest

from sillage.llm import bpe, secretscan
from sillage.llm.queries import SECRET_TOKENIZER, TOKEN_PATTERN, op11_secrets

SF = "/root/testdata/sf0.001"
#: The base forms, case spelled out instead of by a flag.
PLAIN = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]+)",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def brute(text):
    return [(m.start(), list(PLAIN).index(k), f"{k}:{m.start()}:{m.end()}") for k, p in PLAIN.items() for m in re.finditer(p, text or "") if len(m.group(1)) >= LEAST[k]]


def scanner():
    return secretscan.Scanner(bpe.load_ranks(SECRET_TOKENIZER), TOKEN_PATTERN, 16, 2.0)


def kinds(text):
    return [(s["kind"], text[s["start"] : s["end"]]) for s in scanner().spans(text)]


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op11_secrets(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = sorted(brute(texts[r["doc_id"]]))
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(f[1] == i for f in found) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f[2] for f in found).encode()).hexdigest()
        assert {f[2] for f in found} <= set(r["spans"].split(",")) | ({""} if not r["spans"] else set())


@pytest.mark.parametrize("alphabet", [string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits])
def test_random_strings_are_found(alphabet):
    draw, scan, missed = random.Random(7), scanner(), 0
    for _ in range(500):
        secret = "".join(draw.choice(alphabet) for _ in range(draw.randrange(24, 60)))
        text = f"the value is {secret} and nothing else"
        missed += (13, 13 + len(secret)) not in {(s["start"], s["end"]) for s in scan.spans(text)}
    assert missed <= 5


def test_words_and_identifiers_are_left_alone():
    clean = [
        "51fc1652-dc6b-4990-b378-e16487708839", "HTTPS://example.com/en/a8f3kq92mzx81pqw7rt", "getUserAccountByIdentifier", "MAX_CONNECTION_POOL_SIZE_2", "Donaudampfschifffahrtsgesellschaft", "internationalization",
        "4111111111111111", "2024-03-05T12-33-44Z", "VLKZOEOYAKHREP-UHFFFAOYSA-N", "DE89370400440532013000", "01ARZ3NDEKTSV4RRFFQ69G5FAV", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "D41D8CD98F00B204E9800998ECF8427E", "spark_sql_shuffle_partitions_200",
    ]
    assert [kinds(f"see {c} here") for c in clean] == [[]] * len(clean)


def test_the_documents_have_no_random_strings_but_secrets(spark):
    rows = op11_secrets(spark, SF).collect()
    assert sum("random" in r["spans"] for r in rows) == 0


def test_forms_overlaps_and_positions():
    assert kinds("PassWord = 'abcdef'") == [("assign", "PassWord = 'abcdef")]
    assert kinds("password=abc passwd: abcdefg") == [("assign", "passwd: abcdefg")]
    assert kinds("ſecret=abcdefgh toKen=abcdefgh") == []  # no letters of ASCII
    token = "0123456789abcdef01234567"
    assert kinds(f"ä😀 token={token}") == [("assign", f"token={token}"), ("hex", token)]
    assert kinds("AKIA" + "Q7" * 8) == [("access", "AKIA" + "Q7" * 8)]
    assert kinds("AKIA" + "Q7" * 7) != [("access", "AKIA" + "Q7" * 7)]
    assert kinds(f"a{token}z") == [("hex", f"a{token}")]
    assert kinds("key Zx81pQw7rTa8f3Kq92Mz== end") == [("random", "Zx81pQw7rTa8f3Kq92Mz==")]


def test_edges(spark):
    long = "word " * 200_000 + "password=abc123def " + "x" * 500_000
    rows = [(1, None), (2, ""), (3, long), (None, "token: qwertz1"), (4, "token: qwertz1"), (4, "token: qwertz1")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, spans string, key int")
    found = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in secretscan.find_secrets(df, bpe.load_ranks(SECRET_TOKENIZER), TOKEN_PATTERN).collect()), key=str)
    one = [("assign", 0, 14)]
    assert found == sorted([(1, []), (2, []), (3, [("assign", 1_000_000, 1_000_018)]), (None, one), (4, one), (4, one)], key=str)
    assert secretscan.find_secrets(df.limit(0), bpe.load_ranks(SECRET_TOKENIZER), TOKEN_PATTERN).count() == 0
