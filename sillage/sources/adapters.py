"""Landed answers that need more than a list of fields: candidates, reactions, descriptors, genes, assays, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.functions import measures, properties
from sillage.functions.text import split_terms
from sillage.operators.ordered import first_per_key
from sillage.sources.documents import by_column, sections, with_status

_CANDIDATE = "struct<chebi_accession:string,id:string,name:string,formula:string,charge:int,inchikey:string,smiles:string,cas:string>"


def candidates(answers: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, pos, id, name, match, status) of search answers, the surest match first.

    ``targets`` has key, inchikey, cas, smiles and name.  status of a key: ok if its
    first candidate is verified, else candidate.  Elements may be wrapped in ``_source``.
    """
    parsed = F.from_json("payload", f"struct<results:array<struct<_source:{_CANDIDATE},{_CANDIDATE.removeprefix('struct<')}>>")
    rows = answers.select("key", F.posexplode(parsed["results"]).alias("at", "e"))
    pick = lambda f: F.coalesce(F.col(f"e._source.{f}"), F.col(f"e.{f}"))
    rows = rows.select("key", "at", F.coalesce(pick("chebi_accession"), pick("id"), F.lit("")).alias("id"), *(F.coalesce(pick(f), F.lit("")).alias(f"c_{f}") for f in ("name", "inchikey", "smiles", "cas")))
    joined = rows.join(targets, "key")
    names = {"key": "inchikey", "number": "cas", "structure": "smiles", "name": "name"}
    ranked = joined.withColumn("match", measures.identity_rank({k: F.coalesce(F.col(c), F.lit("")) for k, c in names.items()}, {k: F.col(f"c_{c}") for k, c in names.items()}))
    order = Window.partitionBy("key").orderBy(F.desc("match.rank"), "at")
    first = F.first("match.verified").over(order)
    return ranked.select("key", F.row_number().over(order).alias("pos"), "id", F.col("c_name").alias("name"), "match", F.when(first, "ok").otherwise("candidate").alias("status"))


def reactions(rows: DataFrame) -> DataFrame:
    """Reactions of a TSV scan (id, equation, compounds, ec, enzymes): lists split at semicolons, ``EC `` removed; rows without an id are left out."""
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    good = rows.filter(F.coalesce(F.trim("id"), F.lit("")) != "")
    return good.select(F.trim("id").alias("reaction"), F.trim("equation").alias("equation"), parts("compounds").alias("compounds"), F.transform(parts("ec"), lambda x: F.trim(F.regexp_replace(x, "^EC ", ""))).alias("ec_numbers"), F.trim(F.coalesce("enzymes", F.lit(""))).alias("enzymes"))


def descriptors(answers: DataFrame) -> DataFrame:
    """One row for each key with a molecule: its names and its lists of descriptors, split at ``@`` or a comma."""
    fields = ["cas_id", "flavor_profile", "fema_flavor_profile", "taste", "odor", "functional_groups"]
    parsed = F.from_json("payload", "struct<pubchem_id:string,common_name:string," + ",".join(f"{f}:string" for f in fields) + ">")
    rows = answers.select("key", parsed.alias("m"))
    lists = [split_terms(F.coalesce(F.col(f"m.{f}"), F.lit("")), "[@,]").alias(f) for f in fields]
    return rows.select("key", properties.canonical_id(F.col("m.pubchem_id")).alias("cid"), F.col("m.common_name").alias("common_name"), *lists, F.col("m.pubchem_id").isNotNull().alias("found"))


def summaries(answers: DataFrame, element: str) -> DataFrame:
    """(key, pos, id, e) of summary answers: an object by id, in the order of its list of ids."""
    ids = F.from_json(F.get_json_object("payload", "$.result.uids"), "array<string>")
    by_id = F.from_json(F.get_json_object("payload", "$.result"), "map<string,string>")
    rows = answers.select("key", by_id.alias("m"), F.posexplode(ids).alias("pos", "id"))
    return rows.select("key", "pos", "id", F.from_json(F.try_element_at("m", F.col("id")), element).alias("e")).filter("e is not null")


def genes(answers: DataFrame) -> DataFrame:
    """(key, pos, gene, symbol, description, taxon, organism)."""
    rows = summaries(answers, "struct<uid:string,name:string,description:string,organism:struct<scientificname:string,taxid:bigint>>")
    return rows.select("key", "pos", F.coalesce("e.uid", "id").alias("gene"), F.col("e.name").alias("symbol"), F.coalesce("e.description", F.lit("")).alias("description"), F.col("e.organism.taxid").alias("taxon"), F.col("e.organism.scientificname").alias("organism"))


def taxa(answers: DataFrame) -> DataFrame:
    """(key, taxon, name, rank, lineage), lineages split at semicolons."""
    rows = summaries(answers, "struct<scientificname:string,commonname:string,rank:string,lineage:string>")
    return rows.select("key", F.col("id").cast("long").alias("taxon"), F.col("e.scientificname").alias("name"), F.coalesce("e.rank", F.lit("")).alias("rank"), split_terms(F.coalesce("e.lineage", F.lit("")), ";").alias("lineage"))


def assays(answers: DataFrame, *, limit: int = 100) -> DataFrame:
    """(key, assays, total, status): assays as maps of column to cell, those without an AID left out, the first ``limit`` kept and all counted."""
    table = F.get_json_object("payload", "$.Table")
    columns = F.from_json(F.get_json_object(table, "$.Columns.Column"), "array<string>")
    cells = F.transform(F.from_json(F.get_json_object(table, "$.Row"), "array<struct<Cell:array<string>>>"), lambda r: r["Cell"])
    parsed = F.struct(columns.alias("columns"), cells.alias("rows"))
    listed = F.filter(by_column(parsed), lambda m: F.coalesce(F.try_element_at(m, F.lit("AID")), F.lit("")) != "")
    # generated, so that a filter on the total is not pushed below and the payload read twice
    rows = answers.select("key", F.explode(F.array(listed)).alias("all"))
    out = rows.select("key", F.slice("all", 1, limit).alias("assays"), F.coalesce(F.size("all"), F.lit(0)).alias("total"))
    return with_status(out, "key", "assays")


def property_records(answers: DataFrame, headings: dict[str, str], *, depth: int = 4) -> DataFrame:
    """(key, property, text, value, unit, temperature, pressure, medium) of nested section records.

    ``headings`` maps a section's heading to a property; of equal texts of a property
    the first counts.
    """
    rows = answers.select("key", F.posexplode(sections(F.col("payload"), depth)).alias("pos", "s"))
    name = F.lit(None).cast("string")
    for heading, key in headings.items():
        name = F.when(F.col("s.heading") == heading, key).otherwise(name)
    named = rows.select("key", "pos", name.alias("property"), F.trim("s.text").alias("text")).filter("property is not null and text <> ''")
    kept = first_per_key(named, ["key", "property", "text"], ["pos"])
    value: Column = F.lit(None)
    for key in dict.fromkeys(headings.values()):
        value = F.when(F.col("property") == key, properties.property_value(F.col("text"), key)).otherwise(value)
    return kept.withColumn("v", value).select("key", "pos", "property", "text", "v.value", "v.state", "v.unit", "v.temperature", "v.pressure", "v.medium")
