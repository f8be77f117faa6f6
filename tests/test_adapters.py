"""Landed answers of the larger services, and the page index's report."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sillage.operators import pageindex, rollup
from sillage.sources import adapters

KEY = "ABCDEFGHIJKLMN-OPQRSTUVWX-N"


def answers(spark, *rows):
    return spark.createDataFrame([(k, json.dumps(p) if isinstance(p, dict) else p) for k, p in rows], "key string, payload string")


def test_candidates_are_ranked(spark):
    found = answers(spark, ("a", {"results": [{"_source": {"chebi_accession": "C2", "name": "x"}}, {"id": "C1", "name": "ethyl acetate", "inchikey": KEY}]}), ("b", {"results": [{"id": "C3", "name": "ethanol"}]}), ("c", {"results": []}))
    targets = spark.createDataFrame([("a", KEY, None, None, "x"), ("b", "", "", "", "Ethanol")], "key string, inchikey string, cas string, smiles string, name string")
    got = [(r["key"], r["id"], r["match"]["rank"], r["status"]) for r in adapters.candidates(found, targets).orderBy("key", "pos").collect()]
    assert got == [("a", "C1", 5, "ok"), ("a", "C2", 1, "ok"), ("b", "C3", 1, "candidate")]


def test_reactions(spark):
    rows = spark.createDataFrame([("RHEA:1", "a = b", "CHEBI:1; CHEBI:2;", "EC 1.1.1.1;EC 2.2.2.2", None), (" ", "x", None, None, None)], "id string, equation string, compounds string, ec string, enzymes string")
    assert [tuple(r) for r in adapters.reactions(rows).collect()] == [("RHEA:1", "a = b", ["CHEBI:1", "CHEBI:2"], ["1.1.1.1", "2.2.2.2"], "")]


def test_descriptors(spark):
    rows = answers(spark, ("1", {"pubchem_id": "0088", "common_name": "n", "flavor_profile": "sweet@fruity, green", "odor": None}), ("2", {}), ("3", None))
    got = {r["key"]: (r["cid"], r["flavor_profile"], r["odor"], r["found"]) for r in adapters.descriptors(rows).collect()}
    assert got == {"1": ("88", ["sweet", "fruity", "green"], [], True), "2": (None, [], [], False), "3": (None, [], [], False)}


def test_genes_and_taxa(spark):
    rows = answers(spark, ("k", {"result": {"uids": ["7", "5", "9"], "5": {"uid": "5", "name": "G5", "organism": {"scientificname": "O", "taxid": 9606}}, "7": {"name": "G7"}}}))
    assert [(r["gene"], r["symbol"], r["taxon"]) for r in adapters.genes(rows).orderBy("pos").collect()] == [("7", "G7", None), ("5", "G5", 9606)]
    rows = answers(spark, ("9606", {"result": {"uids": ["9606"], "9606": {"scientificname": "Homo sapiens", "rank": "species", "lineage": "a; b ;"}}}))
    assert [tuple(r) for r in adapters.taxa(rows).collect()] == [("9606", 9606, "Homo sapiens", "species", ["a", "b"])]


def test_assays(spark):
    table = {"Table": {"Columns": {"Column": ["AID", "Outcome"]}, "Row": [{"Cell": ["1", "Active"]}, {"Cell": ["", "x"]}, {"Cell": ["2", "Inactive"]}]}}
    got = {r["key"]: r for r in adapters.assays(answers(spark, ("k", table), ("n", {"Table": {"Columns": {"Column": ["AID"]}, "Row": []}}), ("bad", "<html>")), limit=1).collect()}
    assert got["k"]["assays"] == [{"AID": "1", "Outcome": "Active"}] and got["k"]["total"] == 2 and got["k"]["status"] == "ok"
    assert got["n"]["status"] == "no_data" and got["bad"]["status"] == "invalid_response"


def test_property_records(spark):
    payload = {"Section": [{"TOCHeading": "All", "Section": [{"TOCHeading": "Boiling Point", "Information": [{"Value": "77.1 °C"}, {"Value": "77.1 °C"}, {"Value": "70-80 °C"}]}, {"TOCHeading": "Other", "Information": [{"Value": "x"}]}]}]}
    got = adapters.property_records(answers(spark, ("k", payload)), {"Boiling Point": "boiling_point", "Vapor Pressure": "vapor_pressure"}).orderBy("pos").collect()
    assert [(r["property"], r["text"], r["value"], r["unit"]) for r in got] == [("boiling_point", "77.1 °C", 77.1, "°C"), ("boiling_point", "70-80 °C", None, None)]


def test_report_meets_its_gates(spark):
    blocks = spark.createDataFrame([(1, 1, "141-78-6 呈香气", "compound_profile"), (1, 2, "水中阈值0.5μg/L，xx", "threshold")], "page int, block int, text string, block_type string")
    thresholds = pageindex.threshold_records(pageindex.block_entities(blocks))
    metrics = pageindex.report(blocks, thresholds, {"double_x": "xx"})
    got = {r["metric"]: r["value"] for r in metrics.collect()}
    assert (got["blocks"], got["entities"], got["thresholds"], got["medium:水"], got["bad:double_x"]) == (2, 1, 1, 1, 1)
    limits = spark.createDataFrame([("blocks", 2, "min"), ("bad:double_x", 0, "max")], "metric string, limit int, kind string")
    assert {r["metric"]: r["passed"] for r in rollup.gates(metrics, limits).collect()} == {"blocks": True, "bad:double_x": False}
    assert thresholds.filter(F.col("entity") == "141-78-6").count() == 1
