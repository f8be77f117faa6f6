"""Queries for contracts, audit descriptions, headings and released folders."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.functions import audit
from sillage.operators.contracts import Contract, Rule
from sillage.plans.registry import query, table
from sillage.sources import releases
from sillage.workspace import fresh, local_path


@query(
    "p07_table_contract",
    """
WITH l AS (SELECT l_orderkey || '|' || l_linenumber AS k, l_orderkey, l_linenumber, CASE WHEN l_quantity = 50 THEN NULL ELSE l_quantity END AS q, l_extendedprice AS p, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem),
i AS (
  SELECT 'NULL_VALUE' AS code, 'FAIL' AS severity, 'l_quantity' AS about, count(*) AS rows, min(k) AS first, max(k) AS last FROM l WHERE q IS NULL
  UNION ALL SELECT 'REPEATED_KEY', 'FAIL', 'l_orderkey,l_linenumber', count(*), min(k), max(k) FROM l WHERE n > 1
  UNION ALL SELECT 'OUT_OF_RANGE', 'REVIEW', 'l_extendedprice', count(*), min(k), max(k) FROM l WHERE p > 60000)
SELECT * FROM i WHERE rows > 0 UNION ALL SELECT * FROM (VALUES ('MISSING_COLUMN', 'FAIL', 'l_comment', NULL, NULL, NULL), ('UNEXPECTED_COLUMN', 'FAIL', 'l_tax', NULL, NULL, NULL))
""",
)
def p07(spark: SparkSession, d: str) -> DataFrame:
    """Lines against what is promised of them, seen while they are written."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") != 50, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", "l_tax")
    promised = Contract(["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_comment"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_quantity"], (Rule("OUT_OF_RANGE", "l_extendedprice", F.col("l_extendedprice") > 60000, "REVIEW"),))
    rows, checked = promised.check(lines)
    rows.write.parquet(fresh(spark, "contract"))
    return checked.issues()


_CELLS = r"""
WITH c AS (
  SELECT event_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN value::VARCHAR WHEN 2 THEN '"' || event_type || '"' WHEN 3 THEN 'null' WHEN 4 THEN '[' || user_id || ', "' || event_type || '", null]'
    WHEN 5 THEN ['NaN', 'Infinity', '-Infinity'][user_id % 3 + 1] WHEN 6 THEN event_type || ' ' || value END AS cell FROM events),
t AS (SELECT *, CASE WHEN json_valid(cell) THEN json_type(cell) END AS kind FROM c)
SELECT event_id, CASE WHEN cell IS NULL THEN 'undefined' WHEN cell IN ('NaN', 'Infinity', '-Infinity') THEN 'number' WHEN kind IS NULL OR kind = 'VARCHAR' THEN 'string' WHEN kind IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(kind) ELSE 'number' END AS type,
  CASE WHEN cell IS NULL THEN 'undefined' WHEN kind IS NULL THEN cell WHEN kind IN ('OBJECT', 'ARRAY') THEN json(cell)::VARCHAR WHEN kind = 'NULL' THEN 'null' WHEN kind = 'VARCHAR' THEN json_extract_string(cell, '$') ELSE regexp_replace(json_extract_string(cell, '$'), '\.0$', '') END AS display FROM t
"""


@query("p12_audit_values", _CELLS)
def p12(spark: SparkSession, d: str) -> DataFrame:
    """Cells of all kinds made from events, described for an audit."""
    kind, user, value = F.col("event_type"), F.col("user_id").cast("string"), F.col("value").cast("string")
    odd = F.get(F.array(*map(F.lit, ("NaN", "Infinity", "-Infinity"))), (F.col("user_id") % 3).cast("int"))
    made = [F.col("props"), value, F.concat(F.lit('"'), kind, F.lit('"')), F.lit("null"), F.concat(F.lit("["), user, F.lit(', "'), kind, F.lit('", null]')), odd, F.concat(kind, F.lit(" "), value)]
    cell = F.lit(None).cast("string")
    for i, text in enumerate(made):
        cell = F.when(F.col("event_id") % 8 == i, text).otherwise(cell)
    return table(spark, d, "events").select("event_id", audit.described_cell(cell).alias("x")).select("event_id", "x.type", "x.display")


_HEADINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '[^\s]+') AS word, left(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), 60) AS head FROM documents),
n AS (SELECT *, repeat(word, (doc_id % 4 + 1)::INTEGER) AS name, CASE doc_id % 3 WHEN 0 THEN 'Chapter ' || doc_id % 7 || ' ' || head || ' 123' WHEN 1 THEN head || ' see Chapter ' || doc_id % 7 ELSE head || '  045 ' END AS line FROM w)
SELECT doc_id, CASE WHEN length(name) > 0 AND length(name) % 2 = 0 AND left(name, (length(name) // 2)::INTEGER) = substr(name, length(name) // 2 + 1) THEN left(name, (length(name) // 2)::INTEGER) ELSE name END AS name,
  CASE WHEN name = '' THEN 0 ELSE list_min(list_filter(range(1, length(name) + 1), lambda p: length(name) % p = 0 AND substr(name, p + 1) = left(name, (length(name) - p)::INTEGER))) END::INTEGER AS period,
  coalesce(CASE regexp_extract(trim(line), '^Chapter ([0-9]+)', 1) WHEN '1' THEN 'One' WHEN '2' THEN 'Two' END, trim(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '\s*[0-9]{3}\s*$', ''))) AS heading,
  starts_with(line, 'Chapter ' || doc_id % 7) OR regexp_matches(line, '(?s)^.{0,3}Chapter [0-9]+') AND length(trim(line)) <= 100 AS is_heading,
  regexp_matches(line, 'Chapter [0-9]+') AND regexp_matches(line, '[0-9]{2,3}\s*$') AS is_running FROM n
"""


@query("p16_headings", _HEADINGS)
def p16(spark: SparkSession, d: str) -> DataFrame:
    """Doubled names and headings made of the documents' own words and lines."""
    text, key, mark = F.coalesce("text", F.lit("")), F.col("doc_id"), r"^Chapter ([0-9]+)"
    head = F.left(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), F.lit(60))
    chapter = F.concat(F.lit("Chapter "), (key % 7).cast("string"))
    line = F.when(key % 3 == 0, F.concat(chapter, F.lit(" "), head, F.lit(" 123"))).when(key % 3 == 1, F.concat(head, F.lit(" see "), chapter)).otherwise(F.concat(head, F.lit("  045 ")))
    name = F.repeat(F.regexp_extract(text, r"[^\t\n\f\r ]+", 0), (key % 4 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", name.alias("name"), line.alias("line"))
    return rows.select(
        "doc_id",
        audit.halved(F.col("name")).alias("name"),
        audit.period(F.col("name")).alias("period"),
        audit.clean_heading(F.col("line"), mark, {"1": "One", "2": "Two"}).alias("heading"),
        audit.is_heading(F.col("line"), mark).alias("is_heading"),
        audit.is_running_header(F.col("line"), mark).alias("is_running"),
    )


@query(
    "p33_release_problems",
    """
WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 97 = 3 THEN 'd' || p_partkey % 5 || '/part-' || p_partkey || '.sqlite.gz' ELSE 'd' || p_partkey % 5 || '/part-' || p_partkey || '.txt' END AS path FROM part)
SELECT path, 'digest' AS problem FROM p WHERE k % 101 = 5 UNION ALL SELECT path, 'size' FROM p WHERE k % 101 = 6 UNION ALL SELECT path, 'unlisted' FROM p WHERE k % 101 = 7 UNION ALL SELECT path, 'missing' FROM p WHERE k % 101 = 8
UNION ALL SELECT path, 'malformed' FROM p WHERE k % 101 = 9 UNION ALL SELECT path, 'repeated' FROM p WHERE k % 101 = 10 UNION ALL SELECT path, 'packed database' FROM p WHERE k % 97 = 3 AND k % 101 <> 8
""",
)
def p33(spark: SparkSession, d: str) -> DataFrame:
    """A file for each part, released with a manifest that says the wrong thing here and there."""
    folder, key = fresh(spark, "release"), F.col("p_partkey")
    path = F.concat(F.lit("d"), (key % 5).cast("string"), F.lit("/part-"), key.cast("string"), F.when(key % 97 == 3, ".sqlite.gz").otherwise(".txt"))
    parts = table(spark, d, "part").select("p_partkey", path.alias("path"), F.concat_ws("|", key.cast("string"), "p_name", "p_type").alias("text"))
    target = local_path(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                os.makedirs(os.path.dirname(f"{target}/{name}"), exist_ok=True)
                with open(f"{target}/{name}", "w", encoding="utf-8") as out:
                    out.write(text)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    parts.filter("p_partkey % 101 <> 8").select("path", "text").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    odd, size, digest = key % 101, F.octet_length("text").cast("long"), F.sha2("text", 256)
    manifest = parts.filter(odd != 7).select("path", (size + F.when(odd == 6, 1).otherwise(0)).alias("bytes"), F.when(odd == 5, F.sha2(F.lit("other"), 256)).when(odd == 9, F.upper(digest)).otherwise(digest).alias("sha256"), odd.alias("odd"))
    manifest = manifest.unionByName(manifest.filter("odd = 10")).drop("odd")
    return releases.problems(spark, folder, manifest)
