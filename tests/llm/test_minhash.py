from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from sillage.llm import minhash
from sillage.llm.components import connected_components, union_find
from sillage.llm.queries import op4_minhash
from sillage.llm.scratch import Scratch, sweep
from sillage.llm.shingles import EMPTY, WordHashes, shingle_set, superminhash

SF = "/root/testdata/sf0.001"


def brute(rows, percent=75):
    sets = {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    keys, links = sorted(sets), []
    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                links.append((b, a))
    found = union_find(iter(links))
    return {k: (len(sets[k]), found.get(k, k), found.get(k, k) == k) for k in keys}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def edited(draw, words, share):
    return " ".join(w if draw.random() > share else f"{w}{draw.randrange(10**6)}" for w in words)


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op4_minhash(spark, SF)) == brute(rows)


def test_families_and_shared_passages_equal_brute_force(spark):
    draw = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [draw.choice(vocabulary) for _ in range(150)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    rows = [(i, edited(draw, base, draw.choice([0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06]))) for i in range(150)]
    rows += [(500 + i, passage + " " + " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(10, 60)))) for i in range(120)]
    rows += [(900 + i, " ".join(base)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(minhash.near_duplicates(df)) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (7, "É a b c d"), (8, "é a b c d"), (None, "one two"), (4, "one two"), (9, "x " * 30_000), (10, "x x x x x")]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, component_id string, rep int")
    out = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert out == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (-1, 1, None, True), (4, 1, 4, True), (9, 1, 9, True), (10, 1, 9, False)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 4, 6, 7, 8, 9]


def test_prefix_pairs_lose_nothing(spark):
    draw = random.Random(2)
    sets = {i: set(draw.sample(range(80), draw.randrange(20, 60))) for i in range(60)}
    sets |= {100 + i: (sets[i] - set(list(sets[i])[:2])) | {1000 + i} for i in range(60)}
    rows = [(k, len(s), x) for k, s in sets.items() for x in s]
    members = spark.createDataFrame([(k, k) for k in sets], "rep long, component long")
    found = minhash._prefix_pairs(members, spark.createDataFrame(rows, "rep long, n long, shingle long"), Scratch(spark, "test"), 75)
    got = {(r["a"], r["b"]) for r in found.collect()}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                assert (a, b) in got


def plain_superminhash(elements, slots):
    """One element and step at a time, with the same generator."""
    from sillage.llm.shingles import _GOLD, mix64

    out = [int(EMPTY)] * slots
    for e in elements:
        perm = list(range(slots))
        for j in range(slots):
            x = int(mix64(np.array([(int(e) + (j + 1) * int(_GOLD)) % 2**64], np.uint64))[0])
            k = j + (((x & 0xFFFFFFFF) * (slots - j)) >> 32)
            slot, perm[k] = perm[k], perm[j]
            perm[j] = slot
            out[slot] = min(out[slot], (x >> 32) | (j << 32))
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 40, 300])
def test_superminhash_equals_the_plain_algorithm(size):
    elements = np.random.default_rng(size).integers(0, 2**64, size, np.uint64)
    got = superminhash([elements, np.empty(0, np.uint64), elements[:1]], 32)
    assert got[0].tolist() == plain_superminhash(elements, 32)
    assert (got[1] == EMPTY).all() and got[2].tolist() == plain_superminhash(elements[:1], 32)


def test_superminhash_estimates_resemblance():
    draw = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        pool = draw.integers(0, 2**64, 400, np.uint64)
        a, b = superminhash([pool[:300], pool[100:]], 128)
        errors.append((a == b).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components_of_paths_stars_and_loops(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(100, 200)] + [(500, 500 + i) for i in range(1, 80)] + [(900, 901), (901, 902), (902, 900)]
    links += [(draw.randrange(2000, 2600), draw.randrange(2000, 2600)) for _ in range(400)]
    draw.shuffle(links)
    found = connected_components(spark.createDataFrame(links, "a long, b long").repartition(7), Scratch(spark, "test"))
    assert {r["node"]: r["component"] for r in found.collect()} == union_find(iter(links))
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_shingles_match_their_definition():
    memo = WordHashes(limit=3)
    assert len(shingle_set("a b c d e f a b c d e f", memo)) == 6
    assert np.array_equal(shingle_set("A B\x0bC\x1cx D E", memo), shingle_set("a b c\x1cx d e", memo))


def test_scratch_tables_are_swept(spark):
    scratch = Scratch(spark, "swept")
    table = scratch.save(spark.range(3))
    assert table.count() == 3
    folder = scratch.folder.removeprefix("file://")
    assert Path(folder).exists()
    sweep(spark)
    assert not Path(folder).exists()


def test_a_shared_passage_lists_no_pairs_of_unlike_texts(spark):
    draw = random.Random(5)
    counts = []
    for copies in (100, 400):
        passage = [10**9 + i for i in range(36)]
        # 8 elements of their own: 36 / 52 = 0.69 similar
        sets = {i: passage + [i * 100 + k for k in range(8)] for i in range(copies)}
        rows = [(k, len(s), x) for k, s in sets.items() for x in s]
        draw.shuffle(rows)
        scratch = Scratch(spark, "test")
        members = spark.createDataFrame([(k, k) for k in sets], "rep long, component long")
        postings = minhash._prefix_postings(members, spark.createDataFrame(rows, "rep long, n long, shingle long"), scratch, 75)
        listed = minhash._prefix_pairs(members, spark.createDataFrame(rows, "rep long, n long, shingle long"), scratch, 75)
        counts.append((postings.count(), listed.count()))
        scratch.drop()
    assert counts[0][1] == counts[1][1] == 0 and 0 < counts[1][0] <= 4 * counts[0][0]


def test_thousands_that_share_a_passage_equal_brute_force(spark):
    draw = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(1500):
        n = draw.choice([4, 6, 8, 10, 12, 14])
        rows.append((i, " ".join([*(f"a{i}x{k}" for k in range(n)), *passage, *(f"b{i}x{k}" for k in range(draw.choice([0, 3, 6])))])))
    want = brute_near(rows)
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == want


def brute_near(rows, percent=75):
    """As ``brute``, by inverted counts, for some thousand rows."""
    import itertools
    from collections import Counter, defaultdict

    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    has = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            has[x].append(k)
    shared = Counter(p for ks in has.values() for p in itertools.combinations(sorted(ks), 2))
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    found = union_find(iter(links))
    return {k: (len(sets[k]), found.get(k, k), found.get(k, k) == k) for k in sets}
