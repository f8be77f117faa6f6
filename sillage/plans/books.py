"""Queries for thresholds of scanned books and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.functions import clauses, names
from sillage.operators import pageindex, thresholds
from sillage.plans.registry import query, table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("h24_threshold_grades", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' OR l_quantity < 5 THEN 'review' WHEN l_linestatus = 'O' THEN 'high' ELSE 'medium' END AS grade FROM lineitem")
def h24(spark: SparkSession, d: str) -> DataFrame:
    flags = F.when(F.col("l_quantity") < 5, F.array(F.lit("unknown_medium"))).otherwise(F.array().cast("array<string>"))
    grade = thresholds.grade(F.when(F.col("l_returnflag") == "R", "needs_review"), flags, F.when(F.col("l_linestatus") == "O", "high"))
    return table(spark, d, "lineitem").select(*LINE, grade.alias("grade"))


@query("h24_conflict_grades", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'review' WHEN 2 THEN 'verified' ELSE 'high' END AS grade FROM part")
def h24_conflicts(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    kind = F.when(m == 0, "name_variant").when(m == 1, "likely_ocr_error").when(m == 2, "source_identity_error").otherwise("something new")
    return table(spark, d, "part").select("p_partkey", thresholds.conflict_grade(kind).alias("grade"))


@query(
    "h25_source_locators",
    "SELECT p_partkey, p_size AS page, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS block, CASE p_partkey % 3 WHEN 0 THEN 'literal' WHEN 1 THEN 'corrected' END AS verification FROM part",
)
def h25(spark: SparkSession, d: str) -> DataFrame:
    fix = lambda a, b: F.struct(F.lit(None).cast("string").alias("reason"), F.lit(a).alias("source_text"), F.lit(b).alias("corrected_text"))
    kind = "array<struct<reason:string,source_text:string,corrected_text:string>>"
    made = F.when(F.col("p_partkey") % 3 == 0, F.array(fix("a", "a"))).when(F.col("p_partkey") % 3 == 1, F.array(fix("a", "a"), fix("a", "b"))).otherwise(F.array().cast(kind))
    record = F.concat(F.lit("p1-"), F.when(F.col("p_partkey") % 2 == 0, "b").otherwise("x"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", thresholds.locator(F.col("p_size"), record, made).alias("l")).select("p_partkey", "l.page", "l.block", "l.verification")


@query("h17_medium_groups", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'air' WHEN 1 THEN 'ethanolWater' WHEN 2 THEN 'wine' WHEN 3 THEN 'beer' WHEN 4 THEN 'water' ELSE 'other' END AS grp FROM part")
def h17(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 6
    media = F.when(m == 0, F.array(F.lit("水"), F.lit("空气"))).when(m == 1, F.array(F.lit("乙醇-水"))).when(m == 2, F.array(F.lit("模拟葡萄酒"), F.lit("水"))).when(m == 3, F.array(F.lit("啤酒"))).when(m == 4, F.array(F.lit("水"))).otherwise(F.array(F.lit("白酒水")))
    return table(spark, d, "part").select("p_partkey", thresholds.medium_group(media).alias("grp"))


@query("h19_entity_keys", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'cas:' || p_partkey || '-00-1' WHEN 1 THEN 'cid:' || p_partkey ELSE 'name:' || lower(p_name) END AS key FROM part")
def h19(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 3
    key = names.entity_key(F.when(m == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("-00-1"))).when(m == 1, " "), F.when(m == 1, F.col("p_partkey")), F.upper("p_name"))
    return table(spark, d, "part").select("p_partkey", key.alias("key"))


@query(
    "d08_thresholds_of_hits",
    """
WITH h AS (SELECT o_orderkey AS hit, [o_orderkey, o_orderkey + 1] AS pages, CASE WHEN o_custkey % 3 = 0 THEN []::INTEGER[] ELSE [(o_custkey % 7)::INTEGER] END AS chunks, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 20 END AS cas FROM orders)
SELECT DISTINCT h.hit, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id FROM h JOIN lineitem ON list_contains(pages, l_orderkey)
WHERE coalesce(cas = l_suppkey % 20, false) OR (l_returnflag = 'R' AND (l_linestatus = 'O' OR cas IS NULL)) OR (cas IS NULL AND (len(chunks) = 0 OR list_contains(chunks, l_linenumber)))
""",
)
def d08(spark: SparkSession, d: str) -> DataFrame:
    """Orders are hits on their own page and the next, lines are thresholds."""
    c = F.col("o_custkey")
    hits = table(spark, d, "orders").select(F.col("o_orderkey").alias("hit"), F.array(F.col("o_orderkey"), F.col("o_orderkey") + 1).alias("pages"), F.when(c % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((c % 7).cast("int"))).alias("chunks"), F.when(c % 2 == 0, c % 20).alias("cas"), F.array(F.lit("R")).alias("names"))
    key = ["page", "block", "l_partkey", "l_suppkey"]
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block"), "l_partkey", "l_suppkey", (F.col("l_suppkey") % 20).alias("cas"), F.col("l_returnflag").alias("subject"), (F.col("l_linestatus") == "O").alias("verified"))
    return thresholds.of_hits(hits, lines, key).select("hit", F.concat_ws(":", *(F.col(x).cast("string") for x in key)).alias("id"))


@query(
    "d15_first_accessions",
    """
WITH f AS (SELECT l_suppkey, l_partkey, min((l_orderkey, l_linenumber)) AS place FROM lineitem GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY place, l_partkey) AS n FROM f)
SELECT l_suppkey, l_partkey, n AS place, CASE WHEN l_partkey % 2 = 0 THEN 'ok' ELSE 'no_data' END AS experimental, CASE WHEN l_partkey % 3 = 0 THEN 'ok' ELSE 'no_data' END AS predicted FROM p WHERE n <= 25
""",
)
def d15(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' first 25 parts against two sources of structures."""
    first = thresholds.first_distinct(table(spark, d, "lineitem").withColumn("_tie", F.col("l_partkey")), "l_suppkey", "l_partkey", ["l_orderkey", "l_linenumber", "_tie"], 25)
    for name, step in (("experimental", 2), ("predicted", 3)):
        source = table(spark, d, "part").filter(F.col("p_partkey") % step == 0).select(F.col("p_partkey").alias("l_partkey"), F.lit("ok").alias(name))
        first = first.join(source, "l_partkey", "left").withColumn(name, F.coalesce(name, F.lit("no_data")))
    return first.select("l_suppkey", "l_partkey", "place", "experimental", "predicted")


@query(
    "d22_structured_tables",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority AS title FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey % 5 = l_linenumber % 5",
)
def d22(spark: SparkSession, d: str) -> DataFrame:
    """Records join the table that their page and table number name."""
    tables = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 5).alias("table_id"), F.col("o_orderpriority").alias("title"))
    rows = table(spark, d, "lineitem").select(*LINE, F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 5).cast("long").alias("table_id"))
    return rows.join(tables, ["page", "table_id"], "left").select(*LINE, "title")


@query("f21_segments", "SELECT p_partkey, i - 1 AS pos, '#' || i || ' ' || CASE i WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE p_brand END AS part FROM part, range(1, 4) t(i) WHERE NOT (i = 3 AND p_partkey % 2 = 0)")
def f21(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("before #1 "), F.col("p_name"), F.lit(" #2 "), F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.concat(F.lit(" #3 "), F.when(F.col("p_brand").isNotNull(), F.regexp_replace("p_brand", "#", "_")))))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(thresholds.segments(said, "#[0-9] ")).alias("pos", "part"))
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"), F.regexp_replace("part", "_", "#").alias("part"))


@query("p18_canonical_names", "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS name FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def p18(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "orders").withColumn("name", F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderpriority")))
    return thresholds.last_named(named, "o_custkey", "name", ["o_orderkey"])


@query("p09_matrix_order", "SELECT p_partkey AS place, p_partkey || ',' || CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE (p_partkey + 1)::VARCHAR END AS keys FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0")
def p09(spark: SparkSession, d: str) -> DataFrame:
    """Of two tables the second lacks each seventh key and has a wrong one at each eleventh place."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("key"))
    other = part.filter("p_partkey % 7 <> 0").withColumn("key", F.when(F.col("p_partkey") % 11 == 0, F.col("key") + 1).otherwise(F.col("key")))
    return thresholds.same_order([part, other], "key", "p_partkey").select("place", F.array_join("keys", ",", "none").alias("keys"))


@query("c16_included_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def c16(spark: SparkSession, d: str) -> DataFrame:
    """Rows are in unless their flag says no; a missing flag says nothing."""
    flag = F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "P", True)
    return table(spark, d, "orders").withColumn("include", flag).filter(F.coalesce("include", F.lit(True))).select("o_orderkey")


@query("p20_short_citations", "SELECT o_orderkey, 'Author ' || o_custkey || ' (' || year(o_orderdate) || 'a)' AS short FROM orders")
def p20(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit(" Author "), F.col("o_custkey").cast("string"), F.lit(" ("), F.year("o_orderdate").cast("string"), F.lit("a) A title (with a remark), 12"))
    return table(spark, d, "orders").select("o_orderkey", names.short_citation(said).alias("short"))


@query(
    "h36_subjects",
    "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '谷氨酰肽' WHEN 1 THEN 'Ala-Gly' WHEN 2 THEN 'Val-Leu-' || p_type WHEN 3 THEN '咖啡因' WHEN 4 THEN '2,3-丁二酮' WHEN 5 THEN '柠檬烯' END AS subject FROM part",
)
def h36(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 7
    said = F.when(m == 0, "即谷氨酰肽[Glu]，呈厚味").when(m == 1, "（3）二肽 Ala-Gly（苦味）").when(m == 2, F.concat(F.lit("其中三肽Val-Leu-"), F.col("p_type"), F.lit("呈苦味"))).when(m == 3, "咖 啡因的苦味阈值").when(m == 4, "啤酒中的2，3-丁二酮（双乙酰）").when(m == 5, "柠檬烯呈柑橘香").otherwise("12.5 mg/L")
    return table(spark, d, "part").select("p_partkey", clauses.subject(said).alias("subject"))


@query(
    "h37_details_and_tables",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '%vol' WHEN 1 THEN p_size || '% w/w' END AS detail, CASE WHEN p_partkey % 2 = 0 THEN '3-' || p_size END AS table_id, CASE WHEN p_partkey % 2 = 0 THEN '酯类' END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'μg/L' END AS unit FROM part",
)
def h37(spark: SparkSession, d: str) -> DataFrame:
    size, m = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    clause = F.when(m == 0, F.concat(size, F.lit(" % vol乙醇-水溶液中嗅阈值 40%vol"))).when(m == 1, F.concat(size, F.lit("%（质量分数）蔗糖溶液中阈值"))).otherwise("水中阈值 40%vol")
    head = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("表 3 － "), size, F.lit(" 酯类 单位：μg/L 序号 名称"))).otherwise("表 3-1 所示的是")
    return table(spark, d, "part").select("p_partkey", clauses.medium_detail(clause).alias("detail"), clauses.table_head(head).alias("t")).select("p_partkey", "detail", "t.table_id", "t.title", "t.unit")


@query(
    "f20_carried_subjects",
    """
WITH b AS (SELECT l_orderkey AS page, (l_linenumber * 100000::BIGINT + l_partkey) * 100000 + l_suppkey AS block, l_linestatus = 'O' AS free, CASE WHEN l_returnflag = 'R' THEN 'Ala-x' || translate((l_suppkey % 10)::VARCHAR, '0123456789', 'abcdefghij') END AS tail FROM lineitem)
SELECT page, block, CASE WHEN free THEN last_value(CASE WHEN free THEN tail END IGNORE NULLS) OVER (ORDER BY page, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS subject FROM b
""",
)
def f20(spark: SparkSession, d: str) -> DataFrame:
    """Lines are blocks of their orders' pages; some end with a name, some have an entity of their own."""
    block = (F.col("l_linenumber").cast("long") * 100000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")
    tail = F.concat(F.lit("text Ala-x"), F.translate((F.col("l_suppkey") % 10).cast("string"), "0123456789", "abcdefghij"))
    blocks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), block.alias("block"), F.when(F.col("l_returnflag") == "R", tail).otherwise("12.5").alias("text"), F.when(F.col("l_linestatus") != "O", "50-00-0").alias("entity"))
    return pageindex.with_subjects(blocks).select("page", "block", "subject")
