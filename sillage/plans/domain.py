"""Queries for names, citations, standards, incremental loads and smaller roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.functions import clauses, measures, names, properties, text
from sillage.operators import assay, dossier, match, ordered, ranking
from sillage.plans.registry import query, table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("c06_evidence_filter", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus <> 'O' AND l_returnflag = 'A'")
def c06(spark: SparkSession, d: str) -> DataFrame:
    """Line status O stands for book evidence; return flags A for water, others for air."""
    rows = table(spark, d, "lineitem").select(*LINE, F.when(F.col("l_linestatus") == "O", "book").otherwise("own").alias("origin"), F.when(F.col("l_returnflag") == "A", "in water").otherwise("air").alias("medium"), F.lit("d").alias("type"))
    return dossier.evidence_filter(rows, include_books=False, medium="water", types=["d"]).select(*LINE)


@query("c08_optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def c08(spark: SparkSession, d: str) -> DataFrame:
    return dossier.optional_equal(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "all"}).select("o_orderkey")


@query(
    "d04_two_hop_names",
    """
WITH b AS (SELECT s_nationkey AS cid, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY 1)
SELECT c_custkey, n_name, name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN b ON n_nationkey = cid
""",
)
def d04(spark: SparkSession, d: str) -> DataFrame:
    """The last of several names of one id wins."""
    last = ordered.last_per_key(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("name")), ["n_nationkey"], ["s_suppkey"])
    nations = table(spark, d, "nation").join(last, "n_nationkey", "left")
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "name")


@query("d06_profile_selection", "(SELECT DISTINCT l_suppkey::VARCHAR AS k FROM lineitem ORDER BY 1 LIMIT 4) UNION ALL SELECT '99999'")
def d06(spark: SparkSession, d: str) -> DataFrame:
    """The first keys of all lines."""
    keys = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("k")).unionAll(spark.createDataFrame([("99999",)], "k string"))
    return dossier.profiles(keys.withColumn("o", F.col("k")), "k", "o", limit=5, selected="99999").select("k")


@query(
    "d25_canonical_fallback",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def d25(spark: SparkSession, d: str) -> DataFrame:
    """What was not extracted but is in the master list."""
    missing = table(spark, d, "orders").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return missing.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("e19_match_rate", "SELECT count(DISTINCT o_custkey) AS compounds, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS matched, round(count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') * 100.0::DOUBLE / count(DISTINCT o_custkey), 4) AS percent FROM orders")
def e19(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").agg(F.countDistinct("o_custkey").alias("compounds"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("matched"))
    return out.withColumn("percent", F.round(F.try_divide(F.col("matched") * 100, F.col("compounds")), 4))


@query("e24_pattern_counts", "SELECT sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS numbers, sum(len(regexp_extract_all(text, '@')))::BIGINT AS ats FROM documents")
def e24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.sum(F.regexp_count("text", F.lit("[0-9]+"))).cast("long").alias("numbers"), F.sum(F.regexp_count("text", F.lit("@"))).cast("long").alias("ats"))


@query(
    "e25_share_of_largest",
    "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, user_id) AS pos, user_id, n, round(n::DOUBLE / max(n) OVER (), 6) AS share FROM c QUALIFY pos <= 30",
)
def e25(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    best = ranking.top(counted, [F.desc("n"), F.col("user_id")], 30)
    return best.select("pos", "user_id", "n", F.round(F.col("n") / F.max("n").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 6).alias("share"))


@query(
    "f10_internal_standards",
    """
WITH s AS (SELECT DISTINCT l_suppkey AS sample, l_suppkey // 3 AS grp FROM lineitem),
a AS (SELECT l_suppkey, l_partkey, max(round(l_extendedprice * 100)::BIGINT) AS area FROM lineitem WHERE l_partkey IN (7, 11) GROUP BY ALL),
f AS (SELECT s.*, x.area AS ex, y.area AS sub FROM s LEFT JOIN a x ON x.l_suppkey = sample AND x.l_partkey = 7 LEFT JOIN a y ON y.l_suppkey = sample AND y.l_partkey = 11),
g AS (SELECT *, coalesce(ex, sub) AS v, count(coalesce(ex, sub)) OVER (PARTITION BY grp) AS n, sum(coalesce(ex, sub)) OVER (PARTITION BY grp) AS t FROM f)
SELECT sample, CASE WHEN v IS NOT NULL THEN v::DOUBLE WHEN n = 2 THEN t::DOUBLE / 2 END AS area, CASE WHEN ex IS NOT NULL THEN 'measured' WHEN sub IS NOT NULL THEN 'substituted' WHEN n = 2 THEN 'imputed' ELSE 'missing' END AS status FROM g
""",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    samples = lines.select(F.col("l_suppkey").alias("sample")).distinct().select("sample", F.floor(F.col("sample") / 3).alias("group"), F.lit("7").alias("standard_cas"))
    records = lines.select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").cast("string").alias("cas"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("area"))
    return assay.standards(records, samples, [("7", "11")]).select("sample", F.col("area").cast("double").alias("area"), "status")


@query(
    "f17_header_forward_fill",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
s AS (SELECT *, sum(CASE WHEN length(line) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS record FROM l)
SELECT doc_id, record::BIGINT AS record, sha256(string_agg(line, ' ' ORDER BY pos)) AS body FROM s GROUP BY ALL
""",
)
def f17(spark: SparkSession, d: str) -> DataFrame:
    """Short lines open a record, others go on with it."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    numbered = ordered.blocks(lines, ["doc_id"], ["pos"], F.length("line") < 20, "record")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ")
    return numbered.groupBy("doc_id", "record").agg(F.sha2(joined, 256).alias("body"))


@query("f19_neighbours", "SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND length(a.text) > 700 AND a.turn - c.turn BETWEEN -1 AND 1)")
def f19(spark: SparkSession, d: str) -> DataFrame:
    """Long turns with the turn before and after."""
    return ordered.neighbours(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], F.length("text") > 700, before=1, after=1).select("conv_id", "turn")


@query("g03_natural_order", "SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY CAST(substr(p_brand, 7) AS INTEGER), p_partkey) AS pos FROM part")
def g03(spark: SparkSession, d: str) -> DataFrame:
    """Brand#10 after Brand#9, within each type."""
    order = [ranking.natural_key(F.col("p_brand")), F.col("p_partkey")]
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return ranking.rank_within(rows, ["p_type"], order).select("p_partkey", "p_type", "pos")


@query("g07_page", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders QUALIFY pos BETWEEN 51 AND 75")
def g07(spark: SparkSession, d: str) -> DataFrame:
    return match.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderkey", "pos")


@query("h09_replicate_names", "SELECT s_suppkey, 'wine' || s_suppkey % 7 AS grp, (s_suppkey % 3 + 1)::INTEGER AS replicate FROM supplier")
def h09(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit(" wine"), (k % 7).cast("string"), F.when(k % 2 == 0, "-").otherwise("_"), (k % 3 + 1).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", names.replicate_of(name).alias("r")).select("s_suppkey", F.col("r.group").alias("grp"), "r.replicate")


@query("h14_latest_year", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y FROM orders")
def h14(spark: SparkSession, d: str) -> DataFrame:
    cited = F.concat(F.lit("A (1801), B ("), F.year("o_orderdate").cast("string"), F.lit(") d 12345 mg/L"))
    return table(spark, d, "orders").select("o_orderkey", measures.latest_year(cited).alias("y"))


@query("h20_names_and_keys", "SELECT c_custkey, 'Customer#' || printf('%09d', c_custkey) AS shown, 'cas:' || c_custkey || '-00-1' AS key FROM customer")
def h20(spark: SparkSession, d: str) -> DataFrame:
    shown = names.display_name(F.concat(F.upper("c_name"), F.lit(" (natural)")))
    key = names.entity_key(F.concat(F.col("c_custkey").cast("string"), F.lit("-00-1")), F.lit(None).cast("long"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", shown.alias("shown"), key.alias("key"))


@query(
    "h34_values_with_roles",
    "SELECT p_partkey, p_size::VARCHAR AS low, CASE WHEN p_partkey % 3 = 0 THEN 'matrix' WHEN p_partkey % 3 = 1 THEN 'sample' ELSE 'threshold' END AS role FROM part",
)
def h34(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 3
    clause = F.concat(F.when(m == 1, "样品中含量").otherwise("水中阈值"), F.col("p_size").cast("string"), F.lit(" μg/L"), F.when(m == 0, "甘油").otherwise("。"))
    return table(spark, d, "part").select("p_partkey", F.explode(clauses.values(clause)).alias("v")).select("p_partkey", "v.low", "v.role")


@query(
    "h38_property_values",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN p_size::DOUBLE END AS value, CASE WHEN p_partkey % 4 <> 3 THEN 'mmHg' END AS unit, CASE WHEN p_partkey % 4 = 0 THEN '25 °C' END AS temperature FROM part",
)
def h38(spark: SparkSession, d: str) -> DataFrame:
    m, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    written = F.when(m == 0, F.concat(size, F.lit(" mm Hg at 25 °C"))).when(m == 3, F.concat(size, F.lit("-99 mm Hg"))).otherwise(F.concat(F.lit("Vapor pressure: "), size, F.lit(".0 mmHg")))
    return table(spark, d, "part").select("p_partkey", properties.property_value(written, "vapor_pressure").alias("v")).select("p_partkey", "v.value", "v.unit", "v.temperature")


@query("h48_terms", "SELECT count(*) AS n, count(DISTINCT term) AS terms FROM (SELECT trim(unnest(string_split(replace(p_name, ' ', ';') || ' ; ' || p_type, ';'))) AS term FROM part) WHERE term <> ''")
def h48(spark: SparkSession, d: str) -> DataFrame:
    joined = F.concat(F.replace("p_name", F.lit(" "), F.lit(";")), F.lit(" ; "), F.col("p_type"))
    return table(spark, d, "part").select(F.explode(text.split_terms(joined)).alias("term")).agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"))


@query(
    "h51_citations",
    "SELECT s_suppkey, 'SURNAME' || translate((s_suppkey % 50)::VARCHAR, '0123456789', 'ABCDEFGHIJ') || ', A. (' || (1950 + s_suppkey % 50) || ')' AS reference, 'exact' AS how FROM supplier",
)
def h51(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 50
    letters = F.translate(k.cast("string"), "0123456789", "ABCDEFGHIJ")
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Surname"), F.lower(letters), F.lit(" et al. ("), (k + 1950).cast("string"), F.lit(")")).alias("c"), F.concat(F.lit("SURNAME"), letters, F.lit(", A. ("), (k + 1950).cast("string"), F.lit(")")).alias("key"))
    found = names.cite(rows, rows.select("key").distinct(), citation="c", key="key")
    return rows.join(found, "c").select("s_suppkey", "reference", "how")


@query(
    "i06_build_report",
    "SELECT CASE WHEN n_regionkey = 1 THEN 'skipped' WHEN n_regionkey = 2 THEN 'failed' ELSE 'updated' END AS outcome, count(DISTINCT n_nationkey) AS libraries, count(s_suppkey) AS rows FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
)
def i06(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("n_regionkey") == 1, "skipped").when(F.col("n_regionkey") == 2, "failed").otherwise("updated")
    rows = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.groupBy(outcome.alias("outcome")).agg(F.countDistinct("n_nationkey").alias("libraries"), F.count("s_suppkey").alias("rows"))


@query("n04_popular_stream", "SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY count DESC, user_id LIMIT 30")
def n04(spark: SparkSession, d: str) -> DataFrame:
    from sillage.streaming import counts

    return counts.drained(counts.popular(counts.event_stream(spark, d), "user_id", 30), "complete")


@query(
    "n08_job_states",
    """
WITH RECURSIVE e AS (SELECT user_id AS job, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'run' ELSE 'wait' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT DISTINCT job, 0::BIGINT AS i, 'created' AS state, 0 AS steps FROM e
  UNION ALL SELECT job, i, next, steps + CASE WHEN next <> state THEN 1 ELSE 0 END FROM (
    SELECT s.job, e.i, s.state, s.steps, CASE WHEN e.action = 'run' AND s.state IN ('created', 'waiting_review', 'failed') THEN 'running' WHEN e.action = 'wait' AND s.state = 'running' THEN 'waiting_review'
      WHEN e.action = 'complete' AND s.state = 'running' THEN 'complete' WHEN e.action = 'fail' AND s.state IN ('created', 'running', 'waiting_review') THEN 'failed' ELSE s.state END AS next
    FROM s JOIN e ON e.job = s.job AND e.i = s.i + 1))
SELECT job, state, steps FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY i DESC) = 1
""",
)
def n08(spark: SparkSession, d: str) -> DataFrame:
    from sillage.streaming import jobs

    return jobs.final_states(table(spark, d, "events").select(F.col("user_id").alias("job"), "ts", "event_id", F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "click", "run").otherwise("wait").alias("action")), "job", ["ts", "event_id"])
