"""Queries for indexes, bundles, resumable and stateful streams, last good values and workbooks of any size."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.operators import lastgood
from sillage.plans.registry import query, table
from sillage.sinks import bundles, workbook
from sillage.sources import sqlite, xlsx
from sillage.streaming import counts, pages, tasks
from sillage.workspace import files, fresh, local_path


@query("a11_index_scan", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size > 25 AND p_name >= 'm'")
def a11(spark: SparkSession, d: str) -> DataFrame:
    """All parts as an index in shards, read back with filters that SQLite applies."""
    folder = fresh(spark, "index")
    sqlite.write_index(table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size"), "p_retailprice"), folder, "parts", "p_partkey", {"schema_version": "1", "index_version": "parts"})
    found = sqlite.read_index(spark, folder, "parts", "p_partkey", 1, rows_per_partition=5_000)
    return found.filter((F.col("p_size") > 25) & (F.col("p_name") >= "m")).select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"), "p_retailprice")


_BUNDLE = """
WITH s AS (
  SELECT 1 AS place, 'lines' AS stage, count(*) AS rows FROM lineitem UNION ALL SELECT 2, 'orders', count(DISTINCT l_orderkey) FROM lineitem
  UNION ALL SELECT 3, 'screened', count(*) FROM lineitem WHERE l_discount <= 0.09 UNION ALL SELECT 4, 'suppliers', count(DISTINCT l_suppkey) FROM lineitem WHERE l_discount <= 0.09 UNION ALL SELECT 5, 'total', 1),
i AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_discount > 0.09))
SELECT 1 AS attempt, 'PARTIAL_FAILED' AS status, 'screened' AS failed, stage, rows, n AS issues FROM s, i WHERE place <= 2
UNION ALL SELECT 2, 'COMPLETE', NULL, stage, rows, n FROM s, i
"""


@query("b11_partial_bundle", _BUNDLE)
def b11(spark: SparkSession, d: str) -> DataFrame:
    """Five stages, of which the third fails at first: two tables and the issues are seen; a second run with milder grading completes."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_discount", "l_extendedprice")

    def stages(severity: str) -> dict[str, bundles.Run]:
        high = F.col("l_discount") > 0.09
        issues = lambda t: t["lines"].filter(high).select(F.lit(severity).alias("severity"), F.lit("HIGH_DISCOUNT").alias("code"), F.col("l_suppkey").cast("string").alias("about")).distinct()
        return {
            "lines": lambda t: lines,
            "orders": lambda t: t["lines"].groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("price")),
            "screened": lambda t: (t["lines"].filter(~high), issues(t)),
            "suppliers": lambda t: t["screened"].groupBy("l_suppkey").count(),
            "total": lambda t: t["suppliers"].agg(F.sum("count").alias("lines")),
        }

    folder, out = fresh(spark, "bundle"), None
    for attempt, severity in enumerate(("FAIL", "REVIEW"), 1):
        seen = bundles.run_stages(spark, folder, stages(severity))
        found = seen.issues.agg(F.count("*").alias("issues"))
        for name, rows in seen.tables.items():
            row = rows.agg(F.count("*").alias("rows")).select(F.lit(attempt).alias("attempt"), F.lit(seen.status).alias("status"), F.lit(seen.failed).cast("string").alias("failed"), F.lit(name).alias("stage"), "rows")
            row = row.crossJoin(F.broadcast(found))  # one row beside one row
            out = row if out is None else out.unionByName(row)
    return out


def _length(spark: SparkSession, path: str) -> int:
    """Bytes of a table's files."""
    fs, target = files(spark, path)
    return fs.getContentSummary(target).getLength()


def _page_files(length: int) -> int:
    """Files that pages of so many bytes are dealt to: at least twelve, and one for each 32 MB."""
    return max(12, -(-length // (32 << 20)))


def _deliver(docs: DataFrame, folder: str, parts: int) -> None:
    """Pages in ``parts`` files, and of every ``parts``-th page one more; only its rows go to the task that writes it."""
    docs.repartition(parts, "page").write.parquet(folder)
    docs.filter(F.col("page") % parts == 5).repartition(1).write.mode("append").parquet(folder)


@query("n07_resumable_pages", "SELECT doc_id AS page, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS lines, coalesce(length(text), 0)::BIGINT AS chars, 1::BIGINT AS times FROM documents")
def n07(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages in files; the work is stopped in the middle, one file comes twice, and it is taken up again."""
    folder = fresh(spark, "pages")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text")
    parts = _page_files(_length(spark, f"{d}/documents.parquet"))
    _deliver(docs, f"{folder}/source", parts)
    per_batch = -(-parts // 3)
    work = lambda rows: rows.select("page", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("lines"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))

    def stop(batch: int) -> None:
        if batch == 1:
            raise RuntimeError("stopped with a batch written and not yet marked as done")

    try:
        pages.process(spark, f"{folder}/source", f"{folder}/work", "page long, text string", work, per_batch=per_batch, before=stop)
    except StreamingQueryException:
        pass
    done = pages.process(spark, f"{folder}/source", f"{folder}/work", "page long, text string", work, per_batch=per_batch)
    return done.groupBy("page").agg(F.max("lines").alias("lines"), F.max("chars").alias("chars"), F.count("*").alias("times"))


_TASKS = """
WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_type, value, event_type || event_id AS task FROM events),
s AS (
  SELECT *, last_value(CASE WHEN event_type = 'signup' THEN us END IGNORE NULLS) OVER w AS saved, last_value(CASE WHEN event_type = 'signup' THEN task END IGNORE NULLS) OVER w AS held,
    last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER w AS kind, count(CASE WHEN event_type IN ('signup', 'error') THEN 1 END) OVER w AS era
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT *, kind = 'signup' AND us < saved + 86400000000 AS alive FROM s),
v AS (
  SELECT *, last_value(CASE WHEN alive AND event_type IN ('signup', 'purchase') THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, era ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS payload,
    max(us) OVER (PARTITION BY user_id) AS final, lead(CASE WHEN event_type IN ('signup', 'error') THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id) AS next_change,
    max(CASE WHEN us < saved + 86400000000 THEN event_id END) OVER (PARTITION BY user_id, era) AS last_alive FROM t),
x AS (
  SELECT user_id, NULL::BIGINT AS seq, 'expired' AS outcome, held AS task, payload, saved + 86400000000 AS at_us FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, era ORDER BY us DESC, event_id DESC) AS nth FROM v WHERE alive)
  WHERE nth = 1 AND (next_change IS NULL OR next_change >= saved + 86400000000)
    AND (final >= saved + 86400000000 OR (saved + 86400000000 + 999) // 1000 <= (SELECT max(us) FROM e) // 1000 - 3600000))
SELECT user_id::VARCHAR AS scope, event_id AS seq, CASE WHEN alive THEN 'found' ELSE 'absent' END AS outcome, CASE WHEN alive THEN held END AS task, CASE WHEN alive THEN payload END AS payload, us AS at_us
FROM v WHERE event_type IN ('view', 'click') UNION ALL SELECT user_id::VARCHAR, seq, outcome, task, payload, at_us FROM x
"""


@query("p38_task_store", _TASKS)
def p38(spark: SparkSession, d: str) -> DataFrame:
    """Signing up saves a user's task for a day, a purchase updates it, an error clears it, views and clicks load it."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "save").when(kind == "purchase", "update").when(kind == "error", "clear").otherwise("load")
    events = counts.event_stream(spark, d).select(F.col("user_id").cast("string").alias("scope"), "ts", F.col("event_id").alias("seq"), action.alias("action"), F.concat(kind, F.col("event_id").cast("string")).alias("task"), F.col("value").alias("payload"))
    return counts.drained(tasks.task_outcomes(events, lifetime=timedelta(days=1)), "append")


_LAST_GOOD = """
WITH a AS (SELECT *, value > 20 AS ok FROM events),
g AS (
  SELECT user_id, event_type, count(*) AS attempts, arg_max(ok, (ts, event_id)) AS last_ok, arg_max(event_id, (ts, event_id)) FILTER (WHERE ok) AS good, arg_max(event_id, (ts, event_id)) AS last FROM a GROUP BY ALL)
SELECT mode, user_id, event_type, good IS NOT NULL AS found, good AS event_id, value, good IS NOT NULL AND NOT last_ok AS stale, CASE WHEN NOT last_ok THEN 'low ' || last END AS error, attempts
FROM g LEFT JOIN (SELECT event_id AS good, value FROM events) USING (good), (VALUES ('table'), ('stream')) m(mode)
"""


def _attempts(events: DataFrame) -> DataFrame:
    return lastgood.last_good(events.withColumn("failure", F.concat(F.lit("low "), F.col("event_id").cast("string"))), ["user_id", "event_type"], ["ts", "event_id"], F.col("value") > 20, ["event_id", "value"], "failure")


@query("p26_last_good", _LAST_GOOD)
def p26(spark: SparkSession, d: str) -> DataFrame:
    """The last good profile of each user and source, from the table and from the stream."""
    batch, stream = _attempts(table(spark, d, "events")), counts.drained(_attempts(counts.event_stream(spark, d)), "complete")
    return batch.select(F.lit("table").alias("mode"), "*").unionByName(stream.select(F.lit("stream").alias("mode"), "*"))


@query(
    "p34_source_fallback",
    """
WITH g AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) FILTER (WHERE value > 20) AS good FROM events GROUP BY ALL),
o AS (SELECT *, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS place FROM g WHERE event_type IN ('error', 'signup', 'click')),
f AS (SELECT user_id, arg_min(event_type, place) FILTER (WHERE good IS NOT NULL) AS source, arg_min(good, place) FILTER (WHERE good IS NOT NULL) AS event_id, min(place) FILTER (WHERE good IS NOT NULL) AS first FROM o GROUP BY 1)
SELECT user_id, source, event_id, (SELECT coalesce(string_agg(event_type, ',' ORDER BY place), '') FROM o WHERE o.user_id = f.user_id AND (first IS NULL OR place < first)) AS skipped FROM f
""",
)
def p34(spark: SparkSession, d: str) -> DataFrame:
    """For each user the first of three sources, in order, that has a good profile."""
    return lastgood.first_source(_attempts(table(spark, d, "events")), ["user_id"], "event_type", ["error", "signup", "click"], ["event_id"])


_REPORT = """
WITH l AS (SELECT l_partkey, count(*) AS lines, sum(l_quantity)::BIGINT AS pieces FROM lineitem GROUP BY 1),
s AS (SELECT l_partkey, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1),
d AS (SELECT p_partkey, p_name, lines, pieces, supplier, CASE WHEN lines IS NULL THEN 'unmatched' ELSE 'matched' END AS note FROM part LEFT JOIN l ON l.l_partkey = p_partkey LEFT JOIN s ON s.l_partkey = p_partkey),
r AS (
  SELECT 'Summary' AS sheet, row_number() OVER (ORDER BY note) + 1 AS source_row, note || '|' || count(*) AS cells FROM d GROUP BY note
  UNION ALL SELECT 'Parts', row_number() OVER (ORDER BY p_partkey) + 1, p_partkey || '|' || p_name || '|' || coalesce(lines::VARCHAR, 'NA') || '|' || coalesce(pieces::VARCHAR, 'NA') || '|' || note FROM d
  UNION ALL SELECT 'Sources', row_number() OVER (ORDER BY p_partkey) + 1, p_partkey || '|' || coalesce(supplier::VARCHAR, 'NA') FROM d
  UNION ALL SELECT 'Suppliers', row_number() OVER (ORDER BY s_suppkey) + 1, s_suppkey || '|' || s_name FROM supplier)
SELECT sheet, source_row::INTEGER AS source_row, cells FROM r
UNION ALL SELECT * FROM (VALUES ('Summary', 1, 'note|parts'), ('Parts', 1, 'p_partkey|p_name|lines|pieces|note'), ('Sources', 1, 'p_partkey|supplier'), ('Suppliers', 1, 's_suppkey|s_name'))
"""


@query("b15_batch_report", _REPORT)
def b15(spark: SparkSession, d: str) -> DataFrame:
    """All parts beside what three tables know of them, as a workbook of four tables, read back from the file; a table longer than a sheet goes on in further ones."""
    lines = table(spark, d, "lineitem")
    known = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("pieces"))
    sources = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("supplier"))
    parts = table(spark, d, "part").select("p_partkey", "p_name").join(known, "p_partkey", "left").join(sources, "p_partkey", "left")
    parts = parts.withColumn("note", F.when(F.col("lines").isNull(), "unmatched").otherwise("matched"))
    sheets = {
        "Summary": parts.groupBy("note").agg(F.count("*").alias("parts")).orderBy("note"),
        "Parts": parts.select("p_partkey", "p_name", "lines", "pieces", "note").orderBy("p_partkey"),
        "Sources": parts.select("p_partkey", "supplier").orderBy("p_partkey"),
        "Suppliers": table(spark, d, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey"),
    }
    folder = fresh(spark, "report")
    totals = workbook.write_parts(sheets, f"{folder}/report.xlsx", folder)
    spark.dataSource.register(xlsx.Workbook)
    read = workbook.joined(spark.read.format("workbook").load(local_path(f"{folder}/report.xlsx")), totals)
    return read.select("sheet", "source_row", F.array_join("cells", "|").alias("cells"))
