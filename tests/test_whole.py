"""Queries and operators do the whole job: no rows are left out by an id, a prefix or a cap."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillage.operators import match, retrieval
from sillage.plans import measurements, registry

SF = "/root/testdata/sf0.001"


def test_every_line_is_quantified(spark):
    lines = registry.table(spark, SF, "lineitem")
    parts = lines.select("l_partkey").distinct().count()
    made = registry.queries()
    assert made["l16_semiquantitation"](spark, SF).select("l_partkey").distinct().count() == parts
    cents = lines.agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))).first()[0]
    shares = lines.groupBy("l_partkey", measurements.replicate_of().alias("rep")).count()
    assert made["l16_semiquantitation"](spark, SF).count() == shares.count()
    grid = measurements._grid(spark, SF).filter("n_valid = 3")
    wide = made["l17_statistics_by_group"](spark, SF)
    retained = made["e07_mean_sd_cv"](spark, SF).filter("status = 'retained'")
    assert grid.count() and wide.count() == retained.select("l_partkey").distinct().count()
    whole = lines.groupBy("l_partkey", (F.col("l_suppkey") % 10).alias("grp"), measurements.replicate_of().alias("rep")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"))
    complete = whole.groupBy("l_partkey", "grp").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    assert complete.agg(F.sum("c")).first()[0] == cents
    assert grid.agg(F.sum("value")).first()[0] == complete.filter("n = 3").agg(F.sum("c")).first()[0]


def test_the_batch_is_all_parts_and_candidates_are_joined_by_gram(spark):
    made = registry.queries()["l06_batch_review"](spark, SF)
    assert made.count() == registry.table(spark, SF, "part").count()
    records = spark.createDataFrame([(1, "Red ring"), (2, "red ring"), (3, "blue Ringlet"), (4, "ö%_ x"), (5, None), (6, "")], "k int, n string")
    asked = spark.createDataFrame([(q,) for q in ["ring", "RINGLET", "red ring", "3", "ö%", "%", "_ x", "g", "zzz", "", None, "ring"]], "q string")
    found = match.tiered_match(asked, records, q="q", key="k", names=["n"])
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = {r["q"]: (r["tier"], r["n_candidates"], r["match"], r["status"]) for r in found.collect()}
    assert found.count() == 12
    assert got == {
        "ring": (3, 3, None, "candidate"), "RINGLET": (3, 1, None, "candidate"), "red ring": (2, 2, None, "conflict"), "3": (1, 1, 3, "exact"), "ö%": (3, 1, None, "candidate"), "%": (3, 1, None, "candidate"),
        "_ x": (3, 1, None, "candidate"), "g": (3, 3, None, "candidate"), "zzz": (None, 0, None, "unmatched"), "": (2, 1, 6, "exact"), None: (None, 0, None, "unmatched"),
    }


def test_edges_reach_every_part_and_keys_come_from_all_lines(spark):
    made, lines = registry.queries(), registry.table(spark, SF, "lineitem")
    nations = registry.table(spark, SF, "nation").filter("n_regionkey <> 2")
    suppliers = registry.table(spark, SF, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    pairs = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_suppkey", "l_partkey").distinct()
    assert made["l22_evidence_graph"](spark, SF).filter("type = 'catalyzed_by'").count() == pairs.count()
    keys = sorted({str(r[0]) for r in lines.select("l_suppkey").distinct().collect()})[:4]
    assert sorted(r["k"] for r in made["d06_profile_selection"](spark, SF).collect()) == sorted([*keys, "99999"])


def test_terms_beyond_two_hundred_score(spark):
    names = [f"β-name {'x' * (i % 7)}{i:04d}" for i in range(450)]
    entities = spark.createDataFrame([(f"key-{k}", names[k * 50 : k * 50 + 50]) for k in range(9)], "key string, names array<string>")
    terms = retrieval.expand_terms(spark, "β-name", entities)
    assert {n for n in names} <= {t for t, _ in terms}
    last = [t for t, _ in terms if t in set(names)][-1]
    rows = [(0, 0, f"{last} at the start, then {last}"), (0, 1, None), (1, 2, "of key-3 only"), (2, 3, "nothing"), (3, 4, f"ends in {terms[0][0]}")]
    chunks = spark.createDataFrame(rows, "page int, chunk int, text string")

    def expected(terms):
        scores = {p: sum(w + 4 * min(x.count(t) - 1, 3) + 18 * (t in x[:180]) for t, w in terms if t in x) for p, _, x in rows if x}
        return {p: score for p, score in scores.items() if score > 0}

    for asked in (terms, terms[:20]):
        assert {r["page"]: r["score"] for r in retrieval.search(chunks, asked).collect()} == expected(asked)


def test_following_over_runs(spark):
    from sillage.operators import ordered

    rows = [(k, i) for k, step in (("a", 3), ("b", 700), (None, 11)) for i in range(-40, 4000, step)]
    df = spark.createDataFrame(rows + rows[:5], "k string, i long")
    want = {}
    for k in ("a", "b", None):
        ids = sorted({i for key, i in rows if key == k})
        want |= {(k, i): j for i, j in zip(ids, [*ids[1:], None], strict=True)}
    assert {(r["k"], r["i"]): r["following"] for r in ordered.following(df, "k", "i", run=50).collect()} == want


def test_long_overlays_equal_short_ones(spark):
    import random

    from sillage.operators import match

    draw = random.Random(1)
    rules = [(p, lo := draw.randrange(5000), lo + draw.choice([0, 3, 40, 900]), f"v{p}") for p in range(400)]
    df = spark.range(0, 6000).withColumnRenamed("id", "at")
    frame = spark.createDataFrame(rules, "p int, lo long, hi long, v string")
    got = {r["at"]: r["v"] for r in match.range_overlay(df, frame, at="at", low="lo", high="hi", position="p").collect()}
    assert got == {i: next((v for _, lo, hi, v in rules if lo <= i <= hi), None) for i in range(6000)}


def test_a_lost_publication_is_put_back(spark, tmp_path):
    from sillage.sinks import exports

    path = f"{tmp_path}/t"
    exports.publish(spark, spark.range(4), path)
    (tmp_path / "t").rename(tmp_path / "t.old-x")
    exports.recover(spark, path)
    assert spark.read.parquet(path).count() == 4
    exports.publish(spark, spark.range(6), path)
    assert spark.read.parquet(path).count() == 6 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]
