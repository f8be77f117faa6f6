"""Threshold evidence, batch review and the evidence graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.functions import measures, text
from sillage.operators.ordered import from_first_origin, occurrence


def cross_reference(entry: Column, own: Column) -> Column:
    """Whether an entry only points to another compound: it names a foreign registry number and states no value."""
    foreign = F.size(F.filter(text.registry_numbers(entry), lambda n: n != own)) > 0
    return foreign & (measures.threshold(entry)["status"] == "unparsed")


def threshold_evidence(entries: DataFrame, *, key: str = "key", medium: str = "medium", entry: str = "entry", origin: str = "origin", order: list[str]) -> DataFrame:
    """Observations of each entry: type, value, unit (stated or usual for the medium), status, a unique id, and whether it is a cross reference.

    An entry that two origins have counts for the first only; repeats within it stay.
    """
    kept = from_first_origin(entries, [key, medium, entry], origin, [origin, *order])
    parsed = kept.withColumn("_t", measures.threshold(F.col(entry))).withColumn("is_reference", cross_reference(F.col(entry), F.col(key)))
    rows = parsed.select(*entries.columns, F.col("_t.type").alias("type"), F.col("_t.value").alias("value"), F.coalesce("_t.unit", measures.inferred_unit(F.col(medium))).alias("unit"), F.col("_t.status").alias("status"), "is_reference")
    numbered = occurrence(rows, [key, medium, entry], order)
    return numbered.withColumn("id", F.concat_ws(":", key, medium, F.substring(F.sha2(entry, 256), 1, 12), "occurrence")).drop("occurrence")


def batch_review(inputs: DataFrame, matched: DataFrame, dossiers: DataFrame, *, q: str, key: str) -> DataFrame:
    """Inputs with their match's dossier counts: only an exact match gets one; position keeps repeated inputs apart."""
    # rows without a match meet nothing, so they are spread out instead of sharing the null key's task
    spread = matched.withColumn("_spread", F.when(F.col("match").isNull(), F.pmod(F.xxhash64(*matched.columns), F.lit(1024)) + 1).otherwise(0))
    one = dossiers.withColumn("_one", F.pmod(F.xxhash64(key), F.lit(1)))  # always 0, but not folded away
    joined = spread.join(one, (spread["match"] == one[key]) & (spread["_spread"] == one["_one"]), "left").drop("_spread", "_one")
    priority = F.when(F.col("status") == "conflict", 0).when(F.col("status") == "candidate", 1).when(F.col("status") == "unmatched", 2).otherwise(3)
    return joined.withColumn("priority", priority)


def federated(records: DataFrame, sources: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """Records with every source's fields and status; a source has at most one row for each key, and one without a row is ``no_data``."""
    out = records
    for name, (df, fields) in sources.items():
        side = df.select(key, F.struct(*fields).alias(name), F.lit("ok").alias(f"{name}_status"))
        out = out.join(side, key, "left").withColumn(f"{name}_status", F.coalesce(f"{name}_status", F.lit("no_data")))
    return out


def graph(seeds: DataFrame, reactions: DataFrame, proteins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from verified compounds: participates_in to reactions, catalyzed_by to proteins; unverified seeds give a blocked node only."""
    ok = seeds.filter("verified")
    first = ok.join(reactions, "compound").select(F.col("compound").alias("source"), F.col("reaction").alias("target"), F.lit("participates_in").alias("type")).distinct()
    second = first.select(F.col("target").alias("reaction")).distinct().join(proteins, "reaction").select(F.col("reaction").alias("source"), F.col("protein").alias("target"), F.lit("catalyzed_by").alias("type")).distinct()
    edges = first.unionByName(second)
    nodes = seeds.select(F.col("compound").alias("node"), F.when(F.col("verified"), "ok").otherwise("blocked_unverified_identity").alias("status"))
    nodes = nodes.unionByName(edges.select(F.col("target").alias("node"), F.lit("ok").alias("status")).distinct())
    return nodes, edges


def information_count(fields: list[Column]) -> Column:
    """Non-empty leaves among the fields."""
    total = F.lit(0)
    for f in fields:
        total = total + F.when(F.coalesce(F.trim(f.cast("string")) != "", F.lit(False)), 1).otherwise(0)
    return total
