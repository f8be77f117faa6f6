"""Parsers of landed service answers: each turns (key, payload) rows into typed records with a status.

Fetching is left to whatever lands the payloads; there is one row for each answer.  A
payload that is no JSON gives ``invalid_response``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.operators.ordered import first_per_key


@dataclass(frozen=True)
class Service:
    """How one service's answers are read: the element type, where the list stands, and what to keep of each element."""

    name: str
    element: str
    path: str | None
    fields: dict[str, str]
    keep: str = "true"
    limit: int | None = None
    distinct: str | None = None


# Field names of the services' answers.
SERVICES = {
    s.name: s
    for s in (
        Service("proteins", "primaryAccession string, uniProtkbId string, proteinDescription struct<recommendedName:struct<fullName:struct<value:string>,ecNumbers:array<struct<value:string>>>>, genes array<struct<geneName:struct<value:string>>>, organism struct<scientificName:string,taxonId:bigint>", "results", {"accession": "primaryAccession", "entry": "uniProtkbId", "name": "proteinDescription.recommendedName.fullName.value", "genes": "filter(transform(genes, g -> g.geneName.value), x -> x is not null)", "organism": "organism.scientificName", "taxon": "organism.taxonId", "ec_numbers": "transform(proteinDescription.recommendedName.ecNumbers, e -> e.value)"}, distinct="accession"),
        Service("predicted_structures", "modelEntityId string, globalMetricValue double, latestVersion int, pdbUrl string, cifUrl string", None, {"model": "modelEntityId", "plddt": "globalMetricValue", "version": "latestVersion", "pdb_url": "pdbUrl", "cif_url": "cifUrl"}),
        Service("experimental_structures", "identifier string", "result_set", {"pdb_id": "upper(split_part(identifier, '_', 1))"}, keep="identifier is not null", distinct="pdb_id"),
        Service("receptors", "accession string, entry_name string, name string, family string, species string", None, {"accession": "upper(accession)", "entry": "entry_name", "name": "name", "family": "family", "species": "species"}, keep="upper(accession) = upper(trim(key))"),
        Service("ligand_interactions", "interactionId bigint, targetId bigint, targetName string, targetSpecies string, action string, type string, affinity string, affinityParameter string", None, {"interaction": "interactionId", "target": "targetId", "target_name": "coalesce(targetName, '')", "species": "coalesce(targetSpecies, '')", "action": "coalesce(nullif(action, ''), type, '')", "affinity": "coalesce(affinity, '')", "parameter": "coalesce(affinityParameter, '')"}),
        Service("activities", "activity_id bigint, target_pref_name string, standard_type string, type string, standard_value string, value string, standard_units string, units string", "activities", {"activity": "activity_id", "target": "target_pref_name", "measure": "coalesce(standard_type, type)", "value": "coalesce(standard_value, value)", "units": "coalesce(standard_units, units)"}, limit=100),
        Service("compound_identifiers", "CID bigint, Title string, MolecularFormula string, SMILES string, CanonicalSMILES string, ConnectivitySMILES string, InChIKey string", "PropertyTable.Properties", {"cid": "CID", "title": "Title", "formula": "MolecularFormula", "smiles": "coalesce(SMILES, CanonicalSMILES, ConnectivitySMILES)", "inchikey": "InChIKey"}, limit=1),
        Service("studies", "accession string, name string", "content", {"study": "accession", "title": "name"}, keep="accession like 'MTBLS%'", limit=10),
    )
}


def elements(payload: Column, service: Service) -> Column:
    """The list of elements of an answer; one object stands for a list of one, and a missing list is empty."""
    kind = "array<struct<" + _nested(service.element) + ">>"
    value = F.try_parse_json(payload)
    listed = F.try_variant_get(value, "$" + (f".{service.path}" if service.path else ""), kind)
    if service.path is None:
        single = F.try_variant_get(value, "$", kind.removeprefix("array<")[:-1])
        is_object = F.trim(payload).startswith("{")
        listed = F.when(is_object, F.array(single)).otherwise(listed)
    return F.when(value.isNotNull(), F.coalesce(listed, F.array().cast(kind)))


def _nested(element: str) -> str:
    """``a string, b int`` as struct fields."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(element + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(element[start:i].strip())
            start = i + 1
    return ",".join(p.replace(" ", ":", 1) for p in parts)


def parse(answers: DataFrame, service: str, *, key: str = "key", payload: str = "payload") -> DataFrame:
    """Typed records (key, pos, fields) of a service's answers.  Repeats of the distinct field count once, limits keep the first."""
    s = SERVICES[service]
    rows = answers.select(F.col(key).alias("key"), F.posexplode(elements(F.col(payload), s)).alias("pos", "e")).select("key", "pos", "e.*")
    out = rows.filter(s.keep).selectExpr("key", "pos", *(f"{v} as `{k}`" for k, v in s.fields.items()))
    if s.distinct:
        out = first_per_key(out.filter(f"`{s.distinct}` <> ''"), ["key", s.distinct], ["pos"]).select(out.columns)
    if s.limit:
        out = out.filter(F.col("pos") < s.limit) if not s.distinct and s.keep == "true" else _first(out, s.limit)
    return out


def _first(rows: DataFrame, limit: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).filter(F.col("_n") <= limit).drop("_n")


def statuses(answers: DataFrame, service: str, *, key: str = "key", payload: str = "payload") -> DataFrame:
    """(key, status, records): invalid_query without a key, upstream_unavailable without an answer, invalid_response if it is no JSON, else ok or no_data."""
    s = SERVICES[service]
    counts = parse(answers, service, key=key, payload=payload).groupBy("key").agg(F.count("*").alias("records"))
    asked = answers.select(F.col(key).alias("key"), F.col(payload).alias("payload"))
    joined = asked.join(counts, "key", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    status = (
        F.when(F.coalesce(F.trim(F.col("key")), F.lit("")) == "", "invalid_query")
        .when(F.col("payload").isNull(), "upstream_unavailable")
        .when(elements(F.col("payload"), s).isNull(), "invalid_response")
        .when(F.col("records") > 0, "ok")
        .otherwise("no_data")
    )
    return joined.select("key", status.alias("status"), "records")


def combined(statuses_: dict[str, DataFrame]) -> DataFrame:
    """(key, one column a source, status): all sources' statuses and what they come to.

    ok if one has records and none failed, partial if one has and one failed, no_data if
    none has and none failed, else upstream_unavailable.
    """
    out = None
    for name, df in statuses_.items():
        side = df.select("key", F.col("status").alias(name))
        out = side if out is None else out.join(side, "key", "full_outer")
    columns = [F.coalesce(F.col(n), F.lit("no_data")) for n in statuses_]
    some, failed = (F.array_contains(F.array(*(test(c) for c in columns)), True) for test in (lambda c: c == "ok", lambda c: ~c.isin("ok", "no_data")))
    status = F.when(some & ~failed, "ok").when(some, "partial").when(~failed, "no_data").otherwise("upstream_unavailable")
    return out.select("key", *(c.alias(n) for c, n in zip(columns, statuses_, strict=True)), status.alias("status"))


def by_reference(info: DataFrame, *, key: str, reference: str, name: str, value: str, wanted: list[str], needed: list[str], limit: int = 6) -> DataFrame:
    """Named values of each reference number side by side; those that lack a needed one are left out, and the first ``limit`` of a key stay."""
    rows = info.groupBy(key, reference).agg(*(F.first(F.when(F.col(name) == w, F.col(value)), ignorenulls=True).alias(w) for w in wanted))
    usable = rows.filter(" and ".join(f"`{n}` is not null" for n in needed)) if needed else rows
    ranked = usable.select(F.col(key).alias("key"), F.col(reference).alias("pos"), *wanted)
    return _first(ranked, limit).select(F.col("key").alias(key), F.col("pos").alias(reference), *wanted)
