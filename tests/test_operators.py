"""Golden cases and properties of the operators."""

from __future__ import annotations

import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sillage.functions import measures, spectra, text
from sillage.operators import counters, evidence, match, ordered, ranking, replicates, retrieval, rollup
from sillage.sinks import exports
from sillage.sources import documents, markup
from sillage.sources.xlsx import Workbook, header_rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def peaks(*pairs):
    return F.array(*(F.struct(F.lit(float(m)).alias("mz"), F.lit(float(i)).alias("intensity")) for m, i in pairs))


def test_peaks_are_merged_and_scaled(spark):
    got = one(spark, spectra.normalise(peaks((61.0287, 10), (43.0182, 20), (43.0182, 5), (99, -1), (float("nan"), 4))))
    assert [(p["mz"], p["intensity"]) for p in got] == [(43.0182, 100.0), (61.0287, 40.0)]
    df = spark.createDataFrame([("a", 61.0287, 10.0), ("a", 43.0182, 20.0), ("a", 43.0182, 5.0), ("a", 99.0, -1.0), ("a", None, 4.0)], "k string, mz double, i double")
    assert sorted((r["mz"], r["i"]) for r in rollup.merge_peaks(df, "k", "mz", "i").collect()) == [(43.0182, 100.0), (61.0287, 40.0)]


@pytest.mark.parametrize(
    ("a", "b", "tolerance", "ppm", "similarity", "matched"),
    [
        ([(100, 100), (100.01, 50)], [(100.02, 80)], 0.02, False, None, 1),
        ([(43, 100), (61, 50)], [(43, 100), (61, 50)], 0.1, False, 1.0, 2),
        ([(500, 100), (100, 50)], [(500.004, 100), (100.004, 50)], 10, True, 0.8, 1),
    ],
)
def test_comparison_of_spectra(spark, a, b, tolerance, ppm, similarity, matched):
    got = one(spark, spectra.compare(peaks(*a), peaks(*b), tolerance=tolerance, ppm=ppm))
    assert got["matched"] == matched
    if similarity is not None:
        assert got["similarity"] == similarity
    else:
        assert [(m["a"], m["b"]) for m in got["matches"]] == [(1, 0)]


def test_kinds_of_spectra_are_not_compared(spark):
    got = one(spark, spectra.compare(peaks((43, 100)), peaks((43, 100)), tolerance=0.1, kind_a=F.lit("EI"), kind_b=F.lit("MS2")))
    assert got["similarity"] is None and got["matched"] == 0
    assert one(spark, spectra.adduct(F.lit("M+H"), F.lit(" Positive "))) == "[M+H]+" and one(spark, spectra.ion_mode(F.lit(" Positive "))) == "positive"


lists = st.lists(st.tuples(st.integers(400, 420), st.integers(1, 100)), max_size=8)


@settings(max_examples=15, deadline=None)
@given(lists, lists)
def test_matches_are_symmetric_in_number_and_one_to_one(spark, a, b):
    make = lambda x: spectra.normalise(peaks(*((m / 10, i) for m, i in x)) if x else F.array().cast(spectra.PEAKS))
    row = spark.range(1).select(spectra.compare(make(a), make(b), tolerance=0.15).alias("x"), spectra.compare(make(b), make(a), tolerance=0.15).alias("y")).first()
    used = [(m["a"], m["b"]) for m in row["x"]["matches"]]
    assert len({i for i, _ in used}) == len(used) == len({j for _, j in used})
    assert row["x"]["similarity"] is None or 0 <= row["x"]["similarity"] <= 1.000001
    assert (row["x"]["matched"] == 0) == (row["y"]["matched"] == 0)


RUNS = {
    "adjacent pair": ([(18, 10), (5, 20)], 20, (5, 30, "MERGE_PAIR", 0)),
    "run of three": ([(5, 10), (20, 20), (30, 40)], 20, (5, 30, "MERGE_RUN", 1)),
    "pair too far": ([(5, 10), (30, 40)], 20, (5, 10, "KEEP_LOWER_DISTANCE", 1)),
    "apart and near": ([(5, 10), None, (20, 40)], 20, (20, 40, "KEEP_LARGER_AREA", 1)),
    "apart and far": ([(5, 10), None, (30, 40)], 20, (5, 10, "KEEP_LOWER_DISTANCE_APART", 1)),
    "single": ([(7, 3)], 20, (7, 3, "SINGLE", 0)),
}


@pytest.mark.parametrize("case", RUNS)
def test_duplicate_resolution(spark, case):
    repeats, limit, want = RUNS[case]
    rows = [("s", "other" if r is None else "k", i, float((r or (0, 1))[0]), float((r or (0, 1))[1])) for i, r in enumerate(repeats)]
    df = spark.createDataFrame(rows, "sample string, key string, i int, d double, area double")
    got = replicates.resolve_duplicates(df, sample="sample", key="key", order=["i"], distance="d", area="area", limit=limit).filter("key = 'k'").first()
    assert (got["distance"], got["area"], got["action"], got["n_discarded"]) == want


def test_replicates(spark):
    df = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 140.0), ("b", 1, 7.0), ("b", 2, 10.0), ("b", 3, 13.0), ("c", 1, 5.0), ("d", 1, 0.0)], "k string, rep int, v double")
    grid = replicates.complete_grid(df, keys=["k"], replicate="rep", value="v", replicates=[1, 2, 3])
    got = {(r["k"], r["replicate"]): (r["value"], r["status"]) for r in grid.collect()}
    assert got["a", 3] == (120.0, "imputed") and got["b", 2] == (10.0, "measured") and got["c", 1] == (None, "removed") and got["d", 1] == (None, "dropped")
    stats = {r["k"]: r for r in replicates.mean_sd_cv(grid.filter("k in ('a', 'b', 'd')"), ["k"], "value").collect()}
    assert (stats["b"]["mean"], stats["b"]["sd"], stats["b"]["cv"], stats["b"]["status"]) == (10.0, 3.0, 30.0, "retained")
    assert stats["d"]["status"] == "all_missing"
    with pytest.raises(Exception, match="some of its replicates"):
        replicates.mean_sd_cv(df.filter("k = 'a'"), ["k"], "v").collect()


def test_standard_and_quantities(spark):
    make = lambda include: one(spark, replicates.standard_concentration(F.lit(100.0), F.lit(10.0), F.lit(5.0), F.lit(include)))
    assert make(True) == pytest.approx(1 / 5.01) and make(False) == 0.2
    assert one(spark, replicates.semiquantitate(F.lit(0.0), F.lit(1.0), F.lit(1.0)))["status"] == "zero_area_not_quantifiable"
    assert one(spark, measures.quantity(F.lit("10 μL"), "mL")) == 0.01 and one(spark, measures.quantity(F.lit("10 mg"), "mL")) is None
    assert one(spark, measures.strict_number(F.lit("1e3"))) is None and one(spark, measures.exact_integer(F.lit("9007199254740993"))) is None


@pytest.mark.parametrize(
    ("entry", "want"),
    [
        ("Takeoka et al. (1989) d 0.005 mg/L", ("d", 0.005, "mg/L", "parsed")),
        ("Miller (1999) d < 0.6", ("d", None, None, "unparsed")),
        ("Miller (1999) d 0.017 - 0.020", ("d", None, None, "unparsed")),
        ("Miller (1999) d 0.00", (None, None, None, "unparsed")),
        ("Miller (1999) r 2004", ("r", None, None, "unparsed")),
    ],
)
def test_thresholds(spark, entry, want):
    assert tuple(one(spark, measures.threshold(F.lit(entry)))) == want


def test_cross_references(spark):
    assert one(spark, evidence.cross_reference(F.lit("[1506-02-1]"), F.lit("141-78-6")))
    assert not one(spark, evidence.cross_reference(F.lit("see 1506-02-1, Takeoka (1989) d 0.005 mg/L"), F.lit("141-78-6")))


def test_identity_ladder(spark):
    full = "ABCDEFGHIJKLMN-ABCDEFGHIJ-K"
    a = {"key": F.lit(full), "number": F.lit("141-78-6"), "structure": F.lit("CCO"), "name": F.lit("Ethyl  Acetate")}
    none = {"key": F.lit(""), "number": F.lit(""), "structure": F.lit(""), "name": F.lit("")}
    for change, want in (({"key": F.lit(full)}, (5, True)), ({"key": F.lit("ABCDEFGHIJKLMN-ZZZZZZZZZZ-K")}, (4, True)), ({"number": F.lit("141-78-6")}, (3, True)), ({"structure": F.lit("CCO")}, (2, True)), ({"name": F.lit("ethyl acetate")}, (1, False)), ({}, (0, False))):
        got = one(spark, measures.identity_rank(a, none | change))
        assert (got["rank"], got["verified"]) == want


def test_text_functions(spark):
    assert one(spark, text.checksum_ok(F.lit("141-78-6"))) and not one(spark, text.checksum_ok(F.lit("141-78-5"))) and not one(spark, text.checksum_ok(F.lit("x")))
    assert one(spark, text.normalise_term(F.lit(" Ｅthyl　ace­tate "))) == "ethyl acetate"
    assert one(spark, text.unaccent(F.lit("Évaluée"))) == "evaluee"
    assert one(spark, text.strip_tags(F.lit("<p>a&nbsp;<b>b</b></p>c<br/>d"))) == "a b\nc\nd"
    assert one(spark, text.unescape(F.lit("a&eacute;&#x41;"))) == "aéA"
    assert one(spark, text.spreadsheet_safe(F.lit("141-78-6"))) == '="141-78-6"' and one(spark, text.csv_cell(F.lit('a"b'))) == '"a""b"'
    assert one(spark, text.safe_file_name(F.lit(" a/b:c "))) == "a_b_c"
    assert [one(spark, text.useful_term(F.lit(t))) for t in ("ab", "abc", "酯", "乙酯", "141-78-6")] == [False, True, False, True, True]
    assert one(spark, ranking.natural_key(F.lit("a12"))) > one(spark, ranking.natural_key(F.lit("a2")))


def test_licences(spark):
    assert tuple(one(spark, spectra.licence(F.lit("CC BY-NC-SA"), F.lit("ok")))) == (True, True)
    assert tuple(one(spark, spectra.licence(F.lit("CC BY"), F.lit("needs_review")))) == (False, False)


def test_overlaps_are_merged(spark):
    draw = random.Random(0)
    whole = "".join(draw.choice("abcdefghij") for _ in range(400))
    assert one(spark, rollup.merge_overlap(F.array(F.lit(whole[:200]), F.lit(whole[140:300]), F.lit(whole[150:180]), F.lit("apart")))) == whole[:300] + "\napart"


def test_counters(spark):
    rows = [("c1", "2024-01-01", 1, "A", "甲"), ("c1", "2024-01-02", 2, "B", None), (None, "2024-01-03", 3, "C", "x"), (" ", "2024-01-03", 4, "C", "x")]
    df = spark.createDataFrame(rows, "key string, ts string, i int, name string, local string")
    got = counters.upsert_counters(df, "key", "ts", ["name"], ["local"], "i").collect()
    assert [tuple(r) for r in got] == [("c1", 2, "2024-01-02", "B", "甲")]


def test_graph_blocks_unverified_seeds(spark):
    seeds = spark.createDataFrame([("c1", True), ("c2", False)], "compound string, verified boolean")
    reactions = spark.createDataFrame([("c1", "r1"), ("c2", "r2")], "compound string, reaction string")
    proteins = spark.createDataFrame([("r1", "P1"), ("r1", "P1"), ("r1", "P2"), ("r2", "P3")], "reaction string, protein string")
    nodes, edges = evidence.graph(seeds, reactions, proteins)
    assert sorted(tuple(r) for r in edges.collect()) == [("c1", "r1", "participates_in"), ("r1", "P1", "catalyzed_by"), ("r1", "P2", "catalyzed_by")]
    assert {r["node"]: r["status"] for r in nodes.collect()}["c2"] == "blocked_unverified_identity"


def test_order_operators_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, i % 3, "ab"[i // 4 % 2]) for i in range(60)], "i int, k int, t string")
    for f in (lambda d: ordered.first_per_key(d, ["k"], ["i"]), lambda d: ordered.last_per_key(d, ["k"], ["i"]), lambda d: ordered.islands(d, ["k"], ["t"], ["i"]), lambda d: ordered.occurrence(d, ["t"], ["i"])):
        assert sorted(map(tuple, f(df).collect())) == sorted(map(tuple, f(df.repartition(7)).collect()))
    near = ordered.neighbours(df.filter("k = 0"), ["k"], ["i"], F.col("i") == 30, before=1, after=3, stop=F.col("i") == 36)
    assert sorted(r["i"] for r in near.collect()) == [27, 30, 33]


def test_pages_and_bulk_lookup(spark):
    df = spark.createDataFrame([(i, f"name {i}", "m") for i in range(60)], "i int, name string, medium string")
    assert [r["i"] for r in match.page(df, [F.col("i")], 3).collect()] == list(range(50, 60)) == [r["i"] for r in match.page(df, [F.col("i")], 99).collect()]
    found = match.bulk_lookup(df, ["NAME 5", " ", "name 7 ", "5"], ["name"], dedupe=["i"], order=["i"], exact=False)
    assert {r["i"]: r["line"] for r in found.collect()} == {5: 0, 50: 0, 51: 0, 52: 0, 53: 0, 54: 0, 55: 0, 56: 0, 57: 0, 58: 0, 59: 0, 7: 2, 15: 3, 25: 3, 35: 3, 45: 3}


def test_search_collapses_pages(spark):
    chunks = spark.createDataFrame([(1, 1, "ethyl acetate in wine"), (1, 2, "acetate"), (2, 3, "nothing"), (3, 4, "Acetate acetate acetate")], "page int, chunk int, text string")
    got = retrieval.search(chunks, [("acetate", 10.0), ("wine", 5.0)]).collect()
    assert [(r["page"], r["score"], r["chunks"]) for r in got] == [(1, 54.0, [1, 2]), (3, 36.0, [4])]
    # a term in the first 180 characters, registry numbers, the named entity, and signs of thresholds and drinks add to the score
    rows = [(1, 1, "x" * 170 + " 13-57-9", None), (2, 2, "x" * 190 + " 13-57-9", ["13-57-9"]), (3, 3, "no term at all", ["13-57-9"]), (4, 4, "13-57-9 threshold 5 mg/L in 啤酒", None), (5, 5, "threshold only", None)]
    chunks = spark.createDataFrame(rows, "page int, chunk int, text string, cas array<string>")
    got = retrieval.search(chunks, [("13-57-9", 80.0)], entities=F.col("cas"), named=["13-57-9"]).collect()
    assert {r["page"]: r["score"] for r in got} == {1: 118.0, 2: 245.0, 3: 145.0, 4: 128.0}
    entities = spark.createDataFrame([("141-78-6", ["Ethyl acetate", "EtOAc"]), ("1-1-1", ["other"])], "key string, names array<string>")
    terms = dict(retrieval.expand_terms(spark, " ETHYL acetate", entities))
    assert terms["ethyl acetate"] == 40.0 and terms["141-78-6"] == 36.0 and terms["etoac"] == 30.0 and "other" not in terms


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"records": [{"i": 1}], "entities": [{"n": "x"}, {"n": "y"}]}')
    parts = documents.json_parts(spark, str(tmp_path / "a.json"), {"records": "struct<i:int>", "entities": "struct<n:string>", "thresholds": "struct<t:int>"})
    assert {k: v.count() for k, v in parts.items()} == {"records": 1, "entities": 2, "thresholds": 0}
    (tmp_path / "b.json").write_text('[{"cas": "000-1"}, {"cas": "2"}]')
    assert documents.json_array(spark, str(tmp_path / "b.json"), "cas string").count() == 2
    (tmp_path / "c.json").write_text('{"a": "1", "b": "2"}')
    assert sorted(map(tuple, documents.key_values(spark, str(tmp_path / "c.json")).collect())) == [("a", "1"), ("b", "2")]
    (tmp_path / "d.tsv").write_text("Reaction identifier\tEquation\nRHEA:1\ta = b\n")
    got = documents.tsv_with_aliases(spark, str(tmp_path / "d.tsv"), {"id": ["Rhea ID", "Reaction identifier"], "enzymes": ["Enzymes"]}).collect()
    assert [tuple(r) for r in got] == [("RHEA:1", None)]
    (tmp_path / "e.tsv").write_text("<!doctype html>\n<p>x\n")
    assert documents.tsv_with_aliases(spark, str(tmp_path / "e.tsv"), {"id": ["id"]}).count() == 0
    assert [r["page"] for r in documents.page_gaps(spark.createDataFrame([(1,), (3,)], "page int"), "page", 4).collect()] == [2, 4]
    html = spark.createDataFrame([(1, '<table><tr><th>a</th></tr><tr><td> b<br>c </td><td>d</td></tr></table><a class="x" href="/u">The <b>Gas</b></a><a href="/u">again</a>')], "id int, html string")
    assert [r["cells"] for r in markup.table_rows(html, "id", "html").orderBy("pos").collect()] == [["a"], ["b\nc", "d"]]
    assert [tuple(r) for r in markup.distinct_links(html, "id", "html").collect()] == [(1, 0, "/u", "The Gas")]


def test_workbooks(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>1.5</v></c></row><row r="4"><c r="B4" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    spark.dataSource.register(Workbook)
    rows = spark.read.format("workbook").load(str(tmp_path / "b.xlsx"))
    assert [tuple(r) for r in rows.orderBy("source_row").collect()] == [("One", 2, ["Name", None, "1.5"]), ("One", 4, [None, "x"])]
    assert header_rows(rows, ["Name"]).first()["header_row"] == 2


def test_publication_is_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    exports.publish(spark, spark.range(5), path, key=["id"])
    for bad in (spark.range(0), spark.range(3).union(spark.range(3))):
        with pytest.raises(ValueError):
            exports.publish(spark, bad, path, key=["id"])
    assert spark.read.parquet(path).count() == 5
    exports.publish(spark, spark.range(7), path)
    assert spark.read.parquet(path).count() == 7
    df = spark.range(6).selectExpr("id", "id % 2 as lib")
    exports.replace_partitions(df, str(tmp_path / "p"), "lib")
    exports.replace_partitions(spark.range(1).selectExpr("id", "1L as lib"), str(tmp_path / "p"), "lib")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1000, 1200), min_size=1, max_size=25), st.lists(st.integers(1000, 1200), min_size=1, max_size=25), st.booleans())
def test_tolerance_joins_lose_no_pair(spark, a, b, ppm):
    tolerance = 30_000.0 if ppm else 30.0
    left = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(a)], "k int, i int, x double")
    right = spark.createDataFrame([(1, j, float(v)) for j, v in enumerate(b)], "k int, j int, y double")
    got = sorted((r["i"], r["j"]) for r in match.tolerance_join(left, right, on=["k"], left="x", right="y", tolerance=tolerance, ppm=ppm).collect())
    near = lambda x, y: abs(x - y) <= ((x + y) / 2 * tolerance * 1e-6 if ppm else tolerance) + 1e-12
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if near(float(x), float(y)))
