from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sillage.llm import langid, mixing, quality
from sillage.llm.queries import WEIGHTS, op1_mixing, op7_quality, op10_language

SF = "/root/testdata/sf0.01"


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, seen, repeats = 0, set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered), lines


EDGES = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "x\nx\nx ", "É#É|", "a\x1cb a\x85b　c", "one two\r\none two\r\n", "b " * 5000, "\n" * 50]


def test_statistics_equal_their_definition(spark):
    draw = random.Random(0)
    texts = EDGES + ["".join(draw.choice(["a", "b", "ab", " ", " ", "\n", "#", "\t", "É", "c d e"]) for _ in range(draw.randrange(80))) for _ in range(500)]
    for text in texts:
        assert quality.statistics(text)[:6] == plain_statistics(text)
    big = np.array([random.Random(1).randrange(5) for _ in range(500)], np.int64)
    assert quality._repeated(big, 5) == quality._repeated(big, 3_000_000)


def test_quality_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = op7_quality(spark, SF).collect()
    assert len(out) == len(docs)
    wrong = {0: [], 1: []}
    for r in out:
        want = plain_statistics(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[:5]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
        if r["doc_id"] in labels and not r["base_failed"]:
            wrong[labels[r["doc_id"]]].append(not r["kept"])
    assert np.mean(wrong[0]) > 0.9 and np.mean(wrong[1]) < 0.02


def test_forest_generalises_and_is_the_same_each_time(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    first = quality.fit_forest(docs, labels.filter("doc_id % 2 = 0"))
    again = quality.fit_forest(docs.repartition(7), labels.filter("doc_id % 2 = 0").repartition(3))
    assert first.threshold == again.threshold and np.array_equal(first.value, again.value)
    held = labels.filter("doc_id % 2 = 1").select("doc_id", "quality").toPandas()
    scored = quality.rule_statistics(docs, forest=first).toPandas().merge(held, on="doc_id")
    scored = scored[~quality.base_fails(scored[quality.COUNTS].to_numpy(), 50, 50)]
    rejected = scored["anomaly"] >= first.threshold
    assert rejected[scored["quality"] == 0].mean() > 0.9 and rejected[scored["quality"] == 1].mean() < 0.03


def plain_path(forest, tree, row):
    """Splits passed on the way to a leaf, and the depth that its rows would still have."""
    node = level = 0
    while forest.column[tree, node] >= 0:
        right = row[forest.column[tree, node]] >= forest.value[tree, node]
        node, level = forest.child[tree, node] + int(right), level + 1
    return level, forest.depth[tree, node]


def test_quality_verdicts_are_path_lengths_of_raw_statistics(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality.fit_forest(docs, labels)
    got = {r["doc_id"]: r for r in op7_quality(spark, SF).collect()}
    harmonic = 2 * (math.log(forest.rows - 1) + 0.5772156649015329) - 2 * (forest.rows - 1) / forest.rows
    for row in docs.limit(80).collect():
        n, chars, symbols, repeats, covered, lines = plain_statistics(row["text"])
        text = row["text"] or ""
        upper = sum(c.lower() != c for c in text)
        raw = np.array([max(chars, 1) / max(n, 1) if chars else 0.0, symbols / max(n, 1), repeats / max(lines, 1), covered / max(n, 1), upper / max(chars, 1), math.log(max(n, 1)), math.log(lines / max(n, 1)) if lines else 0.0])
        if not chars:
            continue
        paths = [plain_path(forest, t, raw) for t in range(len(forest.column))]
        assert all(level <= depth + 1e-9 for level, depth in paths)
        score = 2 ** (-sum(d for _, d in paths) / len(paths) / harmonic)
        assert abs(got[row["doc_id"]]["anomaly"] - score) < 1e-9
        assert got[row["doc_id"]]["kept"] == (not got[row["doc_id"]]["base_failed"] and score < forest.threshold)


def test_separation_is_the_largest_gap_between_distributions():
    x, bad = np.array([[0.0, 5], [1, 5], [2, 5], [3, 5]]), np.array([False, False, True, True])
    assert quality.separation(x, bad).tolist() == [1.0, 0.0] and quality.separation(x, bad & False).tolist() == [1.0, 1.0]


def test_quality_edges(spark):
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(EDGES)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(df, labels).collect()
    assert len(out) == len(EDGES) and not any(r["anomaly"] for r in out)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [None]
    assert quality.judge(df.limit(0), labels.limit(0)).count() == 0


def test_language_query_on_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op10_language(spark, SF).collect()
    assert len(out) == len(docs)
    right = []
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["held_out"]:
            right.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert np.mean(right) > 0.98


def test_language_query_equals_a_plain_naive_bayes(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sizes, buckets = (1, 2, 3), langid.BUCKETS

    def grams(text):
        for n in sizes:
            yield from (text.lower()[i : i + n] for i in range(len(text.lower()) - n + 1))

    def bucket(gram):
        state = 0
        for c in gram:
            state = ((state ^ ord(c)) * 0x01000193) % 2**32
        mixed = ((state ^ (len(gram) * 0x9E37)) * 0x85EBCA6B) % 2**32
        return (mixed ^ (mixed >> 15)) & (buckets - 1)

    memo, counts = {}, {}
    place = lambda g: memo[g] if g in memo else memo.setdefault(g, bucket(g))
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            counts.setdefault(r["lang"], Counter()).update(map(place, grams(r["text"])))
    log = {x: (c, math.log(sum(c.values()) + 0.5 * buckets)) for x, c in counts.items()}
    got = {r["doc_id"]: r for r in op10_language(spark, SF).collect()}
    for r in rows[:150]:
        if not r["text"] or not re.search(r"[^\W\d_]", r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        found = Counter(map(place, grams(r["text"])))
        z = {x: sum(n * (math.log(c[b] + 0.5) - whole) for b, n in found.items()) for x, (c, whole) in log.items()}
        best = max(sorted(z), key=z.get)
        assert got[r["doc_id"]]["lang_pred"] == best
        assert abs(got[r["doc_id"]]["score"] - 1 / sum(math.exp(v - z[best]) for v in z.values())) < 1e-6


def test_language_edges(spark):
    rows = [(1, "der die das und ist nicht", "de"), (2, "the and of to is not", "en"), (3, None, "en"), (4, "", "en"), (6, "12 34 !", None), (None, "the and", "fr"), (7, "und die", None), (8, "the of", "xx" if zlib.crc32(b"8") % 5 == 0 else None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, score int")
    model = langid.fit_language_model(df)
    assert set(model.languages) <= {"de", "en"}
    out = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [out[k]["lang_pred"] for k in (3, 4, 6)] == ["und"] * 3 and out[6]["score"] == 0.0
    if model.languages == ["de", "en"]:
        assert out[7]["lang_pred"] == "de" and out[8]["lang_pred"] == "en"
    none = langid.fit_language_model(df.limit(0))
    assert none.languages == [] and {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_language_scores_do_not_depend_on_batches():
    draw = np.random.default_rng(0)
    model = langid.Model.fit(draw.integers(0, 50, (3, 1 << 10)).astype(float), ["a", "b", "c"], (1, 2, 3))
    texts = ["".join(draw.choice(list("abc de"), n)) for n in (3, 50, 700)] + [None, "x"]
    old = langid._CHUNK
    together = model.predict(texts)
    langid._CHUNK = 40
    try:
        apart = [model.predict([t]) for t in texts]
    finally:
        langid._CHUNK = old
    assert together[0] == [n[0] for n, _ in apart]
    assert np.allclose(together[1], [s[0] for _, s in apart])


def nonnegative_least_squares(a, b):
    """min |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        pull = a.T @ (b - a @ x)
        pull[on] = -np.inf
        if on.all() or pull.max() <= 1e-12 * np.abs(b).max():
            return x
        on[int(np.argmax(pull))] = True
        while True:
            z = np.zeros_like(x)
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z[on] > 0).all():
                x = z
                break
            bad = on & (z <= 0)
            step = np.min(x[bad] / (x[bad] - z[bad]))
            x = x + step * (z - x)
            on &= x > 1e-15
            x[~on] = 0


def misses(p, t, w, target):
    """Misses of the totals as shares of their targets, or of the present tokens if those are 0."""
    mass = t @ p
    return ((w * t) @ p - target) / np.where(target > 0, target, mass)


def best_misses(p, t, target):
    """The same at the independent optimum."""
    scale = np.where(target > 0, target, t @ p)
    return misses(p, t, nonnegative_least_squares((p * t[:, None]).T / scale[:, None], target / scale), target)


def fitted(spark, p, t, weights, **options):
    names = "abcdefgh"[: p.shape[1]]
    table = spark.createDataFrame([(int(a), list(map(float, b))) for a, b in zip(t, p, strict=True)], "n_tokens long, posterior array<double>").repartition(3)
    return mixing.fit_rates(table, list(names), dict(zip(names, weights, strict=True)), **options)


def skewed(draw):
    """Most documents alike, as a hot group of copies is, and a few varied ones."""
    p = np.concatenate([np.tile([0.9, 0.06, 0.04], (4000, 1)), draw.dirichlet([3, 0.3, 0.3], 500)])
    return p, draw.integers(1, 400, len(p))


CASES = {
    "varied": (lambda d: (d.dirichlet([0.3, 0.3, 0.3], 300), d.integers(0, 200, 300)), (0.6, 0.3, 0.1), True),
    "reversed": (lambda d: (d.dirichlet([0.3, 0.3, 0.3], 300), d.integers(0, 200, 300)), (0.05, 0.05, 0.9), True),
    "one domain at 0": (lambda d: (d.dirichlet([0.3, 0.3, 0.3], 300), d.integers(0, 200, 300)), (0.5, 0.5, 0.0), False),
    "skewed": (skewed, (0.985, 0.01, 0.005), True),
    "skewed, rare wanted": (skewed, (0.2, 0.4, 0.4), False),
    "all alike": (lambda d: (np.tile([0.7, 0.2, 0.1], (500, 1)), d.integers(1, 50, 500)), (0.1, 0.1, 0.8), False),
    "rare domain": (lambda d: (np.concatenate([np.tile([0.9999, 0.0001], (900, 1)), np.tile([0.3, 0.7], (3, 1))]), d.integers(1, 300, 903)), (0.9, 0.1), True),
    "hard posteriors": (lambda d: (np.eye(3)[d.integers(0, 3, 200)], d.integers(1, 90, 200)), (0.98, 0.01, 0.01), True),
}


@pytest.mark.parametrize("case", CASES)
def test_rates_against_an_independent_solver(spark, case):
    make, weights, feasible = CASES[case]
    p, t = make(np.random.default_rng(1))
    rates = fitted(spark, p, t, weights)
    w, target = rates.of(p), np.array(weights) * (t @ p).sum()
    assert (w >= 0).all() and np.allclose(rates.totals, (w * t) @ p) and rates.passes <= 25
    got, best = misses(p, t.astype(float), w, target), best_misses(p, t.astype(float), target)
    assert (np.abs(best).max() < 1e-6) == feasible
    if feasible:
        assert np.abs(got).max() <= 1e-3
    else:
        assert np.linalg.norm(got) <= np.linalg.norm(best) * (1 + 1e-3) + 1e-3


def test_feasible_rates_change_least(spark):
    """Of all rates that meet the targets ours are nearest to 1 by token: the multipliers show it."""
    p, t = skewed(np.random.default_rng(2))
    rates = fitted(spark, p, t, (0.8, 0.1, 0.1))
    w = rates.of(p)
    inner = w > 0
    assert np.allclose((w - 1)[inner], -(p @ rates.prices)[inner]) and ((p @ rates.prices)[~inner] >= 1).all()


def test_mixing_query_meets_its_targets(spark):
    labels = {r["doc_id"]: ("low" if not r["quality"] else "toxic" if r["toxic"] else "clean") for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = op1_mixing(spark, SF).collect()
    p, t, w = np.array([r["posterior"] for r in out]), np.array([r["n_tokens"] for r in out], float), np.array([r["rate"] for r in out])
    assert (w >= 0).all() and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    target = np.array([WEIGHTS[d] for d in out[0]["domains"]]) * t.sum() * (p.sum(axis=1) @ t) / t.sum()
    assert np.abs(misses(p, t, w, target)).max() < 1e-3
    share = (w * t) @ p
    share = dict(zip(out[0]["domains"], share / share.sum(), strict=True))
    assert all(abs(share[d] - x) < 0.01 * x for d, x in WEIGHTS.items())
    seen = [(r["domains"][int(np.argmax(r["posterior"]))], labels[r["doc_id"]]) for r in out if r["doc_id"] in labels]
    assert np.mean([a == b for a, b in seen]) > 0.93
    # copies have the rates as their expectation, and only they decide
    assert all(math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) for r in out)
    assert abs(sum(r["copies"] for r in out) - w.sum()) < 4 * math.sqrt(len(out))


def test_posteriors_equal_a_plain_computation(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, again = mixing.fit_classifier(docs, labels), mixing.fit_classifier(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(model.chosen, again.chosen) and np.allclose(model.weights, again.weights, atol=1e-6)
    got = {r["doc_id"]: r for r in mixing.domain_posteriors(docs, model).collect()}
    for row in docs.limit(60).collect():
        words = Counter(mixing._word_bucket(w) for w in (row["text"] or "").encode().split())
        z = np.log1p(np.array([words[int(b)] for b in model.chosen], np.float64)) @ model.weights + model.bias
        e = np.exp(z - z.max())
        assert np.allclose(got[row["doc_id"]]["posterior"], e / e.sum(), atol=1e-4)
        assert got[row["doc_id"]]["n_tokens"] == sum(words.values())


def test_mixing_sends_little_to_the_driver_and_keeps_every_domain(spark):
    # one domain only, and targets that name another
    df = spark.createDataFrame([(i, f"w{i} x y z") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    out = mixing.mixing_rates(df, labels, {"toxic": 1.0}).collect()
    assert {r["rate"] for r in out} == {1.0} or all(r["rate"] >= 0 for r in out)


def test_mix_repeats_rows_as_often_as_their_copies_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).withColumn("copies", F.lit("clash"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights = {"clean": 0.5, "toxic": 0.4, "low": 0.1}
    want = {r["doc_id"]: r["copies"] for r in mixing.mixing_rates(docs, labels, weights).collect() if r["copies"]}
    mixed = mixing.mix(docs, labels, weights)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want


def test_mixing_edges(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (2, "a b"), (2, "a b")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mixing.mixing_rates(df, empty, WEIGHTS).collect()
    assert sorted(r["n_tokens"] for r in out) == [0, 0, 2, 2] and {r["copies"] for r in out} == {1}
    assert mixing.mix(df, empty, WEIGHTS).count() == 4
    labels = spark.createDataFrame([(2, 1, 0), (1, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    assert mixing.mixing_rates(df, labels, WEIGHTS).count() == 4
    assert mixing.mixing_rates(df.limit(0), labels, WEIGHTS).count() == 0


@pytest.mark.parametrize("word", [b"a#", b"ABC", b"abc,", b"Abc"])
def test_word_buckets(word):
    assert mixing._word_bucket(word) == {b"a#": 0, b"ABC": 1}.get(word, mixing._word_bucket(b"abc"))
