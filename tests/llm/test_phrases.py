from __future__ import annotations

import random
import re
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sillage.llm import phrases as module
from sillage.llm import scratch
from sillage.llm.phrases import phrases, top_phrases
from sillage.llm.queries import ORACLES, op12_phrases

SF = "/root/testdata/sf0.01"


def brute(rows, least, longest=5, share=100):
    """Every phrase by plain counting; looks at all longer phrases, not those one word longer alone."""
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            count.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {g: f for g, f in count.items() if f >= least}
    covered = Counter()
    for g, f in often.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                inner = (g[0], *g[i : i + k])
                covered[inner] = max(covered[inner], f)
    out = {}
    for g, a in often.items():
        if len(g) > 2 and not (g in covered and 100 * covered[g] >= share * a):
            cuts = [(1000 * a * n[g[0]] // (often[g[: k + 1]] * often[(g[0], *g[k + 1 :])]), k) for k in range(1, len(g) - 1)]
            score, k = min(cuts)
            out[g[0], " ".join(g[1:])] = (a, often[g[: k + 1]], often[(g[0], *g[k + 1 :])], n[g[0]], score)
    return out


def found(df):
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def texts(draw, count):
    words = ["the", "The", "of", "new", "york", "city", "é", "bank", "a", "x.y", "tab\tbed", "line\nend"]
    fixed = ["new york city hall of fame", "once upon a time there was", "the bank of the river"]
    return [" ".join(draw.choice(fixed) if draw.random() < 0.3 else draw.choice(words) + draw.choice(["", "", ",", "!"]) for _ in range(draw.randrange(1, 60))) for _ in range(count)]


@pytest.mark.parametrize("share", [100, 60])
def test_equals_brute_force(spark, share):
    draw = random.Random(5)
    rows = [(draw.choice(["en", "en", "de", None]), t) for t in texts(draw, 400)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert found(phrases(df, least=15, share=share)) == brute(rows, 15, share=share)


def test_query_equals_sql(spark):
    for name in ("documents",):
        duckdb.sql(f"create or replace view {name} as select * from '{SF}/{name}.parquet'")
    df = op12_phrases(spark, SF)
    relation = duckdb.sql(ORACLES["op12_phrases"])
    assert df.columns == relation.columns
    rows = sorted(map(tuple, df.collect()))
    assert rows and rows == sorted(relation.fetchall())


def test_long_texts_are_cut_between_pieces_only(monkeypatch):
    monkeypatch.setattr(module, "SLICE_BYTES", 10)
    runs = list(module._slices(b"aa bb cc dd ee ff. GG hh; ii"))
    assert runs == [[b"aa", b"bb", b"cc", b"dd", b"ee", b"ff", b"\xff", b"\xff"], [b"gg", b"hh", b"\xff", b"ii", b"\xff"]]


def test_pairs_with_one_hash_are_kept_apart(monkeypatch):
    draw = np.random.default_rng(1)
    left, right = draw.integers(0, 5, 300), draw.integers(0, 5, 300)
    for hashed in (module._hashed, lambda a, b: (a % 2).astype(np.uint64)):
        monkeypatch.setattr(module, "_hashed", hashed)
        order = module._by_pair(left, right)
        pairs = list(zip(left[order].tolist(), right[order].tolist(), strict=True))
        assert sum(a != b for a, b in zip(pairs, pairs[1:], strict=False)) == len(set(pairs)) - 1


@pytest.mark.parametrize("most", [10_000, 60])
def test_blocks_are_filled_by_language(monkeypatch, most):
    """All languages' blocks went together, so each had a share of a block's words, and its own list of words for each part."""
    monkeypatch.setattr(module, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(module, "BLOCK_WORDS", 50)
    monkeypatch.setattr(module, "HELD_WORDS", most)
    batch = pa.record_batch({"lang": ["a", "b", "a", "c", "d"] * 40, "text": pa.array([b"x y z"] * 199 + [b". ;"], pa.binary())})
    made = [r for b in module._word_blocks(2)(iter([batch])) for r in b.to_pylist()]
    blocks = [(r["lang"], r["n"]) for r in made if r["part"] is None]
    assert len({r["block"] for r in made}) == len(blocks)
    assert {lang: sum(n for x, n in blocks if x == lang) for lang in "abcd"} == {"a": 240, "b": 120, "c": 120, "d": 117}
    assert len(blocks) <= (20 if most > 60 else 40) and max(n for _, n in blocks) < 60


def test_names_are_packed():
    at, ids = np.array([0, 4, 5, 300]), np.array([7, 0, 70_000, 3]) + 9 * module.PART_IDS
    packed = module._packed_names(at, ids, 9)
    assert np.cumsum(module.unpack(packed["at"])).tolist() == at.tolist() and (module.unpack(packed["named"]) + 9 * module.PART_IDS).tolist() == ids.tolist()


def test_blocks_of_the_length_before_go_before_pairs_are_counted(spark, monkeypatch):
    """They stayed beside the pairs' lists and their shuffle, where the disk's peak was."""
    seen, save = [], scratch.Scratch.save
    monkeypatch.setattr(module.Scratch, "save", lambda self, *a, **b: (seen.append((self._count, sum("/phrases-blocks-" in f for f in scratch._folders))) if "/phrases-blocks-" in self.folder else None, save(self, *a, **b))[1])
    before = sum("/phrases-blocks-" in f for f in scratch._folders)
    assert phrases(spark.createDataFrame([("en", "a b c d e f")] * 4, "lang string, text string"), least=3).count() == 2
    assert len(seen) == 10 and [n - before for count, n in seen if count == 1] == [1] * 5


@pytest.mark.parametrize("codes", [[0, 1, 2, -1, 1, 3], [2, 0, -1, -1], [-1], [0], [5, 0, 1, 2, 6, 6, 7]])
def test_codes_are_packed_and_unpacked(codes):
    assert module._unpacked_codes(module._packed_codes(np.array(codes, np.int64))).tolist() == codes


def test_ranks_by_score_count_and_bytes(spark):
    rows = [("en", p, 2, a, 1, 1, 9, s) for p, a, s in [("b", 5, 7), ("é", 5, 7), ("Z", 5, 7), ("c", 6, 7), ("d", 1, 8)]] + [("de", "x", 2, 1, 1, 1, 9, 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, words int, a long, l long, r long, n long, score long")
    out = sorted((r["lang"], r["rank"], r["phrase"]) for r in top_phrases(df, limit=4, spread=3).collect())
    assert out == [("de", 1, "x"), ("en", 1, "d"), ("en", 2, "c"), ("en", 3, "Z"), ("en", 4, "b")]


def test_scores_beyond_64_bits(spark):
    big = 10**13
    df = spark.createDataFrame([(big, 3 * big, [big + 1, big], [big + 2, big])], "f long, n long, heads array<long>, tails array<long>")
    best = df.select(module._lowest_cut(df["f"], df["n"], 2).alias("b")).first()["b"]
    assert best["score"] == 1000 * big * 3 * big // ((big + 1) * (big + 2)) and (best["l"], best["r"]) == (big + 1, big + 2)


def test_edges(spark):
    rows = [("en", None), ("en", ""), (None, ". , ;"), (None, "a b " * 3), (None, "a b " * 3), ("en", "w " * 300_000), ("de", "lone words")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, id long, phrase string")
    out = found(phrases(df, least=4))
    assert out == brute(rows, 4) and ("und", "a b a b") in out
    assert phrases(df.limit(0)).count() == 0
    assert phrases(df.filter("lang = 'de'"), least=2).count() == 0
