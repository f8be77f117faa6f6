"""Scans of JSON, CSV and TSV files and of landed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a file that is one JSON array; anything else fails."""
    return spark.read.option("mode", "FAILFAST").json(path, schema=schema, multiLine=True)


def json_parts(spark: SparkSession, path: str, parts: dict[str, str]) -> dict[str, DataFrame]:
    """Several row lists of one JSON object, each empty if missing; ``parts`` maps a field to its element type."""
    schema = ", ".join(f"`{k}` array<{v}>" for k, v in parts.items())
    whole = spark.read.json(path, schema=schema, multiLine=True)
    return {k: whole.selectExpr(f"inline(`{k}`)") for k in parts}


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of one flat JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """A CSV file with a header; without a schema every column is text, so identifiers stay as they are."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def tsv_with_aliases(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A TSV file whose columns have several spellings; a body of HTML instead of rows gives no rows."""
    raw = csv_table(spark, path, sep="\t")
    if raw.columns and raw.columns[0].lstrip().startswith("<"):
        return raw.limit(0).select(*(F.lit(None).cast("string").alias(c) for c in aliases))
    there = {c.strip().lower(): c for c in raw.columns}
    pick = {c: [there[n.lower()] for n in names if n.lower() in there] for c, names in aliases.items()}
    return raw.select(*(F.coalesce(*(F.col(f"`{n}`") for n in names)).alias(c) if names else F.lit(None).cast("string").alias(c) for c, names in pick.items()))


def page_gaps(pages: DataFrame, page: str, total: int) -> DataFrame:
    """Pages from 1 to ``total`` that are not there."""
    return pages.sparkSession.range(1, total + 1).select(F.col("id").cast("int").alias(page)).join(pages.select(page), page, "left_anti")


def columnar(payload: Column) -> Column:
    """An answer of ``columns`` and rows of cells as an array of maps."""
    return by_column(F.from_json(payload, "struct<columns:array<string>,rows:array<array<string>>>"))


def by_column(parsed: Column) -> Column:
    """A struct of ``columns`` and ``rows`` as an array of maps.

    ``parsed`` is bound once: what a lambda says of an outer expression is worked out
    again for each element, here the whole payload for each of its rows.
    """
    return F.get(F.transform(F.array(parsed), lambda p: F.transform(p["rows"], lambda r: F.map_from_arrays(p["columns"], r))), 0)


def twice_encoded(payload: Column, schema: str) -> Column:
    """JSON in a JSON string."""
    return F.from_json(F.from_json(F.concat(F.lit('{"v":'), payload, F.lit("}")), "v string")["v"], schema)


def sections(payload: Column, depth: int = 4) -> Column:
    """(heading, text) of all sections nested up to ``depth`` levels in a record of ``Section`` lists."""
    kind = "struct<TOCHeading:string,Information:array<struct<Value:string>>>"
    for _ in range(depth - 1):
        kind = kind.replace("struct<TOCHeading", f"struct<Section:array<{kind}>,TOCHeading", 1)
    parsed = F.from_json(payload, f"struct<Section:array<{kind}>>")
    level, found = parsed["Section"], []
    for i in range(depth):
        found.append(F.flatten(F.transform(level, lambda s: F.transform(F.coalesce(s["Information"], F.array()), lambda x: F.struct(s["TOCHeading"].alias("heading"), x["Value"].alias("text"))))))
        if i < depth - 1:
            level = F.flatten(F.filter(F.transform(level, lambda s: s["Section"]), lambda s: s.isNotNull()))
    empty = F.array().cast("array<struct<heading:string,text:string>>")
    return F.concat(*(F.coalesce(f, empty) for f in found))


def with_status(rows: DataFrame, key: str, records: str, failed: Column | None = None) -> DataFrame:
    """``rows`` with the status that every source gives: ok, no_data, or why it failed."""
    has = F.size(F.coalesce(F.col(records), F.array())) > 0
    invalid = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    out = F.when(invalid, "invalid_query")
    if failed is not None:
        out = out.when(failed, "upstream_unavailable")
    return rows.withColumn("status", out.when(F.col(records).isNull(), "invalid_response").when(has, "ok").otherwise("no_data"))
