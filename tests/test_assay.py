"""Instrument sheets, internal standards, names, citations and dossiers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sillage.functions import names, spectra, vocabulary
from sillage.operators import assay, counters, dossier, replicates
from sillage.sources import services


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


SHEET = [
    ["[MC Peak  Table]"],
    ["# of peaks", "3"],
    ["Peak#", "Ret. Index", "Area", "Area"],
    ["1", "1000", "10", "x"],
    ["2", "1100", "20", "x"],
    ["2", "1101", "21", "x"],
    ["3", None, "30", "x"],
    ["[MS Similarity Search Results for Spectrum Process Table]"],
    ["Spectrum#", "Hit #", "CAS #", "Name", "Retention Index"],
    ["1", "1", "141-78-6", "ethyl acetate", "995"],
    ["1", "1", "1-1-1", "later", "1"],
    ["1", "2", "2-2-2", "second", "1"],
    ["2", "1", "64-17-5", "ethanol", None],
    ["[Other]"],
    ["3", "1", "9-9-9", "not here", None],
]


def test_hits_of_a_sheet(spark):
    rows = [("s1", i + 1, r) for i, r in enumerate(SHEET)] + [("s2", 1, ["nothing"])]
    records, issues = assay.hits(spark.createDataFrame(rows, "sheet string, source_row int, cells array<string>").repartition(3))
    got = sorted((r["peak"], r["cas"], r["area"], r["measured_index"], r["search_row"]) for r in records.collect())
    assert got == [(1, "141-78-6", "10", "1000", 10), (2, "64-17-5", "20", "1100", 13), (2, "64-17-5", "21", "1101", 13)]
    found = sorted((r["sheet"], r["code"], r["about"]) for r in issues.collect())
    assert found == [("s1", "HIT1_NOT_FOUND", "3"), ("s1", "REVIEW_DUPLICATE_HIT1", "1"), ("s1", "REVIEW_DUPLICATE_PEAK", "2"), ("s2", "FAIL_MISSING_PEAK_TABLE", None), ("s2", "FAIL_MISSING_SEARCH_RESULTS", None)]
    summary = {r["sheet"]: (r["records"], r["compounds"], r["status"]) for r in assay.sample_summary(records, issues).collect()}
    assert summary == {"s1": (3, 2, "REVIEW"), "s2": (0, 0, "FAIL")}


SAMPLES = "sample string, group string, standard_cas string, form string, liquid_ml double, solid_g double, stock_ug_ml double, spike_ul double, system_ml double, include_spike boolean, matrix string"


def samples(spark, *rows):
    return spark.createDataFrame([(s, g, "123-96-6", "liquid", 5.0, None, 100.0, 10.0, 5.0, True, m) for s, g, m in rows], SAMPLES)


def test_standards_and_amounts(spark):
    table = samples(spark, ("a1", "a", "wine"), ("a2", "a", "wine"), ("a3", "a", "wine"), ("b1", "b", "beer"), ("b2", "b", "beer"), ("b3", "b", "beer"))
    rows = [("a1", "123-96-6", 100.0), ("a2", "589-98-0", 140.0), ("a3", "64-17-5", 5.0), ("b1", "123-96-6", 50.0), ("a1", "64-17-5", 50.0), ("a2", "64-17-5", 0.0)]
    records = spark.createDataFrame(rows, "sample string, cas string, area double")
    found = assay.standards(records, table, [("123-96-6", "589-98-0")])
    got = {r["sample"]: (r["area"], r["detected_cas"], r["status"]) for r in found.collect()}
    assert got == {"a1": (100.0, "123-96-6", "measured"), "a2": (140.0, "589-98-0", "substituted"), "a3": (120.0, None, "imputed"), "b1": (50.0, "123-96-6", "measured"), "b2": (None, None, "missing"), "b3": (None, None, "missing")}
    amount = {(r["sample"], r["cas"]): (r["value"], r["status"]) for r in assay.amounts(records, found, table).collect()}
    assert amount["a1", "64-17-5"] == (pytest.approx(0.5 / 5.01), "quantified") and amount["a2", "64-17-5"] == (None, "zero_area_not_quantifiable")
    stats = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "group string, mean double")
    assert {r["group"]: r["matrix"] for r in assay.split_by_matrix(stats, table).collect()} == {"a": "wine", "b": "beer"}
    with pytest.raises(Exception, match="two matrices"):
        assay.split_by_matrix(stats, samples(spark, ("a1", "a", "wine"), ("a2", "a", "beer"))).collect()


def test_sample_tables_are_checked(spark):
    good = samples(spark, ("a_1", "a", "w"), ("a-1", "a", "w"), ("b", "b", "w")).withColumn("spike_ul", F.when(F.col("sample") == "b", 0.0).otherwise(10.0))
    got = sorted(map(tuple, assay.validate_samples(good).collect()))
    assert got == [("a-1", "repeated_name"), ("a_1", "repeated_name"), ("b", "bad_volume")]


def test_names(spark):
    assert tuple(one(spark, names.replicate_of(F.lit("wine-2")))) == ("wine", 2) and one(spark, names.replicate_of(F.lit("2"))) is None
    assert one(spark, names.display_name(F.lit("ETHYL Acetate (natural)"))) == "Ethyl acetate"
    assert one(spark, names.entity_key(F.lit(""), F.lit(8857), F.lit("x"))) == "cid:8857" and one(spark, names.entity_key(F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(" X "))) == "name:x"
    check = lambda c, *a: one(spark, names.compatible(F.lit(c), F.array(*map(F.lit, a))))
    assert check("Ethyl acetate (EtOAc)", "etoac") and check("cis-3-Hexen-1-ol", "3-hexenol") and not check("Ethanol", "methanol") and check("2-Methylbutanal", "3-methylbutanal")


def test_citations(spark):
    keys = ["AMOORE, J.E. (1986a)", "COMETTO-MUÑIZ, J.E. & W.S. CAIN (1993)", "ANROOIJ, A. VAN (1931)", "ADAMS, D.F., F.A. YOUNG & R.A. LUHR (1968)", "SMITH, A. (1990)", "SMITH, B. (1991)"]
    references = spark.createDataFrame([(k,) for k in keys], "key string")
    asked = ["Amoore (1986a)", "Amoore (1986)", "Cometto-Muñiz & Cain (1993)", "van Anrooij (1931)", "Adams et al. (1968)", "Young, reported (1968)", "Smith (2001)", "Nobody (1990)", "Anrooij (1999)"]
    got = {r["c"]: (r["reference"], r["how"]) for r in names.cite(spark.createDataFrame([(a,) for a in asked], "c string"), references, citation="c", key="key").collect()}
    assert got["Amoore (1986a)"] == got["Amoore (1986)"] == (keys[0], "exact")
    assert got["Cometto-Muñiz & Cain (1993)"] == (keys[1], "exact") and got["van Anrooij (1931)"] == (keys[2], "exact") and got["Adams et al. (1968)"] == (keys[3], "exact")
    assert got["Young, reported (1968)"] == (keys[3], "scored") and got["Smith (2001)"] == got["Nobody (1990)"] == (None, "none")
    assert got["Anrooij (1999)"] == (keys[2], "only_author")
    assert one(spark, names.short_citation(F.lit("Takeoka et al. (1989) d 0.005 mg/L"))) == "Takeoka et al. (1989)"


def test_dossiers(spark):
    df = spark.createDataFrame([("book", "water", "d"), ("own", "air", "r"), ("own", "beer", "d"), ("own", None, None)], "origin string, medium string, type string")
    assert dossier.evidence_filter(df, book_only=True).count() == 1 and dossier.evidence_filter(df, include_books=False, medium="alcohol").count() == 1
    assert dossier.evidence_filter(df, types=[]).count() == 0 and dossier.evidence_filter(df, types=["d"]).count() == 2
    assert dossier.optional_equal(df, {"origin": "own", "medium": "all", "type": None}).count() == 3
    keys = spark.createDataFrame([(str(i % 7), i) for i in range(20)], "k string, i int")
    assert sorted(r["k"] for r in dossier.profiles(keys, "k", "i", limit=3).collect()) == ["0", "1", "2"]
    assert sorted(r["k"] for r in dossier.profiles(keys, "k", "i", limit=3, selected="6").collect()) == ["0", "1", "6"]
    profile = spark.createDataFrame([(1, "fruity, sweet;fruity", None, "ether@sweet")], "k int, a string, b string, c string")
    rows = dossier.sensory_records(profile, "k", {"x": {"odor": F.col("a"), "taste": F.col("b")}, "y": {"odor": F.col("c")}})
    assert [(r["source"], r["kind"], r["term"]) for r in rows.orderBy("pos").collect()] == [("x", "odor", "fruity"), ("x", "odor", "sweet"), ("y", "odor", "ether"), ("y", "odor", "sweet")]
    state = dossier.states({"thresholds": F.lit(3), "sensory": F.lit(0)}, {"sensory": F.lit("no_data")})
    got = one(spark, state)
    assert [s["state"] for s in got[:4]] == ["not_requested", "ready", "no_data", "not_requested"] and one(spark, dossier.chapters_covered(state)) == 1
    lists = spark.createDataFrame([(1, 2, ["b", "c"]), (1, 1, ["a", "b"])], "k int, i int, x array<string>")
    assert dossier.union_in_order(lists, "k", "x", ["i"]).first()["x"] == ["a", "b", "c"]
    peaks = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 0)], "k int, side string, index int")
    matches = spark.createDataFrame([(1, 1, 0)], "k int, a int, b int")
    assert sorted((r["side"], r["index"], r["partner"]) for r in dossier.decorate(peaks, matches, ["k"]).collect() if r["partner"] is not None) == [("a", 1, 0), ("b", 0, 1)]
    assert dossier.visible(spark.createDataFrame([("u",), ("v",)], "user_id string"), "u", False).count() == 1


def test_vocabulary(spark):
    terms = F.array(F.lit("Sweet apple"), F.lit("GREEN"))
    assert one(spark, vocabulary.categories(terms, {"fruity": ["apple", "pear"], "fresh": ["green"], "other": ["smoke"]})) == ["fresh", "fruity"]
    assert one(spark, vocabulary.translate_terms(terms, {"green": "青"})) == ["Sweet apple", "青"] and one(spark, vocabulary.translate_terms(terms, {})) == ["Sweet apple", "GREEN"]
    assert one(spark, vocabulary.replace_words(F.lit("wine, beer"), [("wine", "葡萄酒")])) == "葡萄酒, beer"
    assert one(spark, vocabulary.labels(F.lit("odor threshold in wine"), [("threshold", "threshold"), ("odor", "odor"), ("taste", "taste")])) == ["threshold", "odor"]
    grade = lambda a, n, b, m: one(spark, vocabulary.conflict(F.lit(a), F.array(*map(F.lit, n)) if n else F.array().cast("array<string>"), F.lit(b), F.lit(m), [("已", "己")]))
    assert grade("已醛", ["hexanal"], "己醛", "Hexanal") == "likely_scan_error" and grade("乙醇", [], "甲醇", "Methanol") == "insufficient"
    assert grade("异丁醇", ["x"], "丁醇", "y") == "name_variant" and grade("叶醇", ["cis-3-hexenol"], "别名", "3-Hexenol") == "name_variant" and grade("乙醇", ["ethanol"], "丙酮", "Acetone") == "identity_conflict"


def test_quality_control(spark):
    assert one(spark, replicates.back_calculated(F.lit(50.0), F.lit(100.0), F.lit(2.0), F.lit(1.0005))) and not one(spark, replicates.back_calculated(F.lit(50.0), F.lit(100.0), F.lit(2.0), F.lit(1.1)))
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0)], "k string, c double")
    assert {r["k"]: r["x"] for r in df.groupBy("k").agg(replicates.imputed_concentration(F.col("c")).alias("x")).collect()} == {"a": 2.0, "b": None}


def test_caches_and_sources(spark):
    rows = [("a", "2024-01-02 00:00:00", True, 1), ("a", "2024-01-02 06:00:00", True, 2), ("b", "2024-01-01 00:00:00", True, 3), ("c", "2024-01-02 06:00:00", False, 4), ("d", "2024-01-03 00:00:00", True, 5)]
    cache = spark.createDataFrame(rows, "key string, stored_at string, download_allowed boolean, v int").withColumn("stored_at", F.to_timestamp("stored_at"))
    kept = counters.served(cache, F.lit("2024-01-02 12:00:00").cast("timestamp"))
    assert {r["key"]: r["v"] for r in kept.collect()} == {"a": 2}
    asked = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "key string")
    assert [r["key"] for r in counters.to_fetch(asked, kept, "key").collect()] == ["c"]
    side = lambda *x: spark.createDataFrame(x, "key string, status string")
    got = {r["key"]: r["status"] for r in services.combined({"x": side(("1", "ok"), ("2", "ok"), ("3", "no_data")), "y": side(("1", "no_data"), ("2", "invalid_response"), ("4", "upstream_unavailable"))}).collect()}
    assert got == {"1": "ok", "2": "partial", "3": "no_data", "4": "upstream_unavailable"}
    info = spark.createDataFrame([(1, 7, "CCDC", "a"), (1, 7, "link", "u"), (1, 8, "CCDC", "b"), (1, 9, "link", "w")], "cid int, ref int, name string, value string")
    assert [tuple(r) for r in services.by_reference(info, key="cid", reference="ref", name="name", value="value", wanted=["CCDC", "link"], needed=["link"]).orderBy("ref").collect()] == [(1, 7, "a", "u"), (1, 9, None, "w")]


def test_spectrum_exports(spark):
    peaks = F.array(F.struct(F.lit(43.0).alias("mz"), F.lit(100.0).alias("intensity")))
    assert one(spark, spectra.as_csv(peaks)) == "mz,intensity\n43.0,100.0"
    allowed = spectra.licence(F.lit("CC0"), F.lit("ok"))
    assert one(spark, spectra.exported(allowed, spectra.as_mgf(F.lit("t"), F.lit(50.5), peaks))).startswith("BEGIN IONS\nTITLE=t\nPEPMASS=50.5\n43.0 100.0")
    with pytest.raises(Exception, match="does not allow"):
        one(spark, spectra.exported(spectra.licence(F.lit("closed"), F.lit("ok")), F.lit("x")))
    text = one(spark, spectra.comparison_json(spectra.compare(peaks, peaks, tolerance=0.1), 0.1, False, F.lit("a"), F.lit("b")))
    assert '"similarity":1.0' in text and '"mode":"Da"' in text
