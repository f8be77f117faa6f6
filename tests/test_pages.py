"""Scanned pages, property texts and landed services."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sillage.functions import clauses, properties
from sillage.operators import pageindex
from sillage.sources import services


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "key", "want"),
    [
        ("93.2 mm Hg at 25 °C", "vapor_pressure", (93.2, "mmHg", "25 °C", None)),
        ("Henry's Law constant = 1.34X10-4 atm-cu m/mole at 25 °C", "henrys_law_constant", (1.34e-4, "atm·m³/mol", "25 °C", None)),
        ("78 °C at 760 mm Hg", "boiling_point", (78.0, "°C", None, "760 mmHg")),
        ("70-80 °C", "boiling_point", (None, None, None, None)),
        ("93.2 mm Hg or 100 mm Hg", "vapor_pressure", (None, None, None, None)),
        ("1.2e+ mg/L", "water_solubility", (None, None, None, None)),
    ],
)
def test_property_values(spark, text, key, want):
    got = one(spark, properties.property_value(F.lit(text), key))
    assert (got["value"], got["unit"], got["temperature"], got["pressure"]) == want


def test_other_properties(spark):
    assert one(spark, properties.property_value(F.lit("log Kow = 0.73"), "experimental_logp"))["value"] == 0.73
    assert one(spark, properties.property_value(F.lit("Clear liquid"), "physical_state"))["state"] == "liquid"
    assert one(spark, properties.property_value(F.lit("liquid, not a gas"), "physical_state"))["state"] is None
    assert one(spark, properties.property_value(F.lit("In water, 8.0X10+4 mg/L at 25 °C"), "water_solubility"))["medium"] == "water"
    assert [one(spark, properties.canonical_id(F.lit(v))) for v in ("0042", "0", "x1")] == ["42", None, None]


def test_clean_up_is_idempotent(spark):
    rough = "CAS号 141 - 78 - 6 ， 嗅 阈闽值 5 ug/ L；  0.3 μ g/L"
    once = one(spark, clauses.clean(F.lit(rough)))
    assert "141-78-6" in once and "5μg/" in once
    assert one(spark, clauses.clean(F.lit(once))) == once


def test_clauses_and_values(spark):
    statement = "该化合物水中嗅阈值0.5μg/L，10%vol乙醇-水溶液中1.8μg/L，啤酒中3~5μg/L"
    rows = spark.createDataFrame([(1, 1, "threshold", statement, "141-78-6")], "page int, block int, block_type string, text string, entity string")
    got = pageindex.threshold_records(rows).orderBy("clause_pos").collect()
    assert [r["medium"] for r in got] == ["水", "乙醇-水", "啤酒"]
    assert [r["values"][0]["low"] for r in got] == ["0.5", "1.8", "3"] and got[2]["values"][0]["high"] == "5"
    assert {r["threshold_type"] for r in got} == {"odor"} and {r["review_status"] for r in got} == {"ok"}


def test_every_medium_is_told(spark):
    shown = {"乳脂": "在乳脂中", "椰子脂": "椰子脂中", "乳浊液": "水乳浊液中", "糖-酸溶液": "糖-酸溶液中", "MSG溶液": "msg 溶液中", "IMP溶液": "IMP溶液中", "椰子粉": "椰子粉中", "鸡汤": "鸡汤中", "可可粉": "可可粉中", "面粉": "面粉中", "淀粉": "淀粉中", "纤维素": "纤维素中", "其他": "醋中", "油相": "葵花籽油中", "果酒": "苹果酒中", "葡萄酒": "除香红葡萄酒中", "模拟葡萄酒": "模型葡萄酒中", "未明确": "某处"}
    df = spark.createDataFrame([(k, v) for k, v in shown.items()], "m string, t string")
    assert df.filter(clauses.medium(F.col("t")) != F.col("m")).count() == 0 and len(clauses.MEDIA) == 29


def test_glyphs_and_units_are_mended(spark):
    cases = {"嗅國值": "嗅阈值", "噢闽值": "嗅阈值", "嘎阈值": "嗅阈值", "3mg/Lo": "3mg/L。", "CAS 号：141—78—6": "CAS号 141-78-6", "141-78=6": "141-78-6", "2 umol/L": "2μmol/L", "　x　": "x"}
    df = spark.createDataFrame(list(cases.items()), "t string, w string").withColumn("got", clauses.clean(F.col("t")))
    assert [tuple(r) for r in df.filter("got <> w").collect()] == []
    assert [v["unit"] for v in one(spark, clauses.values(F.lit("阈值 ND 5 MG/L")))] == ["MG/L"]


def test_roles_of_concentrations(spark):
    got = one(spark, clauses.values(F.lit("模型葡萄酒（7g/L甘油，4g/L酒石酸）中的阈值0.5μg/L，样品中含量200μg/L")))
    assert [(v["low"], v["role"]) for v in got] == [("7", "matrix"), ("4", "matrix"), ("0.5", "threshold"), ("200", "sample")]
    assert one(spark, clauses.bound(F.lit("不低于 5"))) == "≥5"
    flags = one(spark, clauses.review_flags(F.lit(clauses.UNKNOWN), clauses.values(F.lit("阈值 2000 mg/L，3 pg/L")), F.lit(None).cast("string"), F.lit(""), F.lit("odor")))
    assert flags == ["ambiguous_unit", "unknown_medium", "missing_entity", "suspicious_magnitude"]


def test_blocks_and_their_entities(spark):
    box = lambda top, left=0.0: [left, float(top), 100.0, float(top) + 10.0]
    lines = [(1, 0, "第一章 酯类", 0.9, box(0)), (1, 1, "乙酸乙酯 CAS号 141-78-6 呈", 0.9, box(12)), (1, 2, "果香。", 0.7, box(24)), (1, 3, "阈值很低", 0.9, box(60)), (1, 4, "噪声", 0.1, box(72)), (2, 0, "第二章 醇类", 0.9, box(0)), (2, 1, "没有编号", 0.9, box(60))]
    df = spark.createDataFrame(lines, "page int, pos int, text string, confidence double, box array<double>")
    made = pageindex.page_blocks(df)
    got = [(r["page"], r["block_type"], r["confidence"]) for r in made.orderBy("page", "block").collect()]
    assert [g[1] for g in got] == ["chapter_heading", "threshold", "chapter_heading", "paragraph"] or len(got) >= 4
    found = {(r["page"], r["text"]): (r["entity"], r["association_method"]) for r in pageindex.block_entities(made).collect()}
    assert found[1, "阈值很低"] == ("141-78-6", "inherited") and found[2, "没有编号"] == (None, "none")
    assert pageindex.entities(made).first()["entity"] == "141-78-6"


def test_fixes_apply_in_order_to_the_first_place(spark):
    records = spark.createDataFrame([(1, "a b a b"), (2, "a")], "page int, text string")
    fixes = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", "y"), (1, 2, "q", "z")], "page int, position int, source string, corrected string")
    got = {r["page"]: (r["corrected_text"], r["is_corrected"]) for r in pageindex.correct(records, fixes).collect()}
    assert got == {1: ("x b y b", True), 2: ("a", False)}


def test_landed_services(spark):
    rows = [
        ("R1", '{"results": [{"primaryAccession": "P1", "genes": [{"geneName": {"value": "G"}}, {}], "organism": {"scientificName": "O", "taxonId": 9606}}, {"primaryAccession": "P1"}, {"primaryAccession": "P2"}]}'),
        ("R2", '{"results": []}'),
        ("R3", "<html>"),
        ("R4", None),
        (" ", "{}"),
    ]
    df = spark.createDataFrame(rows, "key string, payload string")
    got = services.parse(df, "proteins").orderBy("pos").collect()
    assert [(r["accession"], r["genes"], r["taxon"]) for r in got] == [("P1", ["G"], 9606), ("P2", None, None)]
    status = {r["key"]: r["status"] for r in services.statuses(df, "proteins").collect()}
    assert status == {"R1": "ok", "R2": "no_data", "R3": "invalid_response", "R4": "upstream_unavailable", " ": "invalid_query"}
    one_object = spark.createDataFrame([("p1", '{"accession": "P1", "name": "n"}'), ("p2", '{"accession": "P9"}')], "key string, payload string")
    assert [r["name"] for r in services.parse(one_object, "receptors").collect()] == ["n"]
    entries = spark.createDataFrame([("k", '{"result_set": [{"identifier": "1abc_1"}, {"identifier": "1ABC_2"}, {"identifier": "2xyz_1"}]}')], "key string, payload string")
    assert [r["pdb_id"] for r in services.parse(entries, "experimental_structures").orderBy("pos").collect()] == ["1ABC", "2XYZ"]
    for name in services.SERVICES:
        assert services.parse(df.limit(0), name).count() == 0
