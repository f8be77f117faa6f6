"""Queries for table operators: filters, overlays, roll-ups, ranks, set operations, caches and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.functions import text
from sillage.operators import assay, counters, dossier, evidence, ordered, ranking, replicates, rollup
from sillage.plans.registry import query, table
from sillage.sinks import exports

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Lines can agree in all of LINE; what orders depend on is decided by these.
LINE_TIES = ["l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
NOW = "timestamp '1998-01-01 00:00:00'"


@query("c04_medium_filter", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def c04(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*LINE, F.when(F.col("l_returnflag") == "A", "Water (pH 7)").otherwise("air").alias("medium"), F.lit("own").alias("origin"))
    return dossier.evidence_filter(rows, medium="water").select(*LINE)


@query(
    "c07_sensory_terms",
    "SELECT p_partkey, t.pos - 1 AS pos, CASE WHEN t.pos <= 2 THEN 'a' ELSE 'b' END AS source, CASE t.pos WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE p_brand END AS term FROM part, range(1, 4) t(pos)",
)
def c07(spark: SparkSession, d: str) -> DataFrame:
    sources = {"a": {"odor": F.concat("p_name", F.lit("; "), "p_type", F.lit(" ;"))}, "b": {"taste": F.concat("p_brand", F.lit(","), "p_brand")}}
    return dossier.sensory_records(table(spark, d, "part"), "p_partkey", sources).select("p_partkey", F.col("pos").cast("long").alias("pos"), "source", "term")


@query(
    "c11_coverage_filter",
    "SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT + (o_custkey % 2 = 0)::BIGINT AS covered FROM orders WHERE covered >= 1",
)
def c11(spark: SparkSession, d: str) -> DataFrame:
    state = dossier.states({"identity": F.when(F.col("o_orderstatus") == "F", 2).otherwise(0), "spectra": F.when(F.col("o_custkey") % 2 == 0, 1)}, {"spectra": F.lit("no_data")})
    rows = table(spark, d, "orders").select("o_orderkey", dossier.chapters_covered(state).cast("long").alias("covered"))
    return rows.filter("covered >= 1")


@query("c14_count_reconciliation", "SELECT count(*) AS n_input, count_if(l_quantity >= 5 AND l_discount <= 0.05) AS n_kept, count_if(l_quantity < 5 OR l_discount > 0.05) AS n_removed FROM lineitem")
def c14(spark: SparkSession, d: str) -> DataFrame:
    rules = [("small", F.col("l_quantity") < 5), ("reduced", F.col("l_discount") > 0.05)]
    return replicates.reconciled(replicates.screen(table(spark, d, "lineitem"), rules))


@query(
    "c15_screen_index_first",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount > 0.05 THEN 'index' WHEN l_quantity < 5 THEN 'area' END AS reason FROM lineitem",
)
def c15(spark: SparkSession, d: str) -> DataFrame:
    rules = [("index", F.col("l_discount") > 0.05), ("area", F.col("l_quantity") < 5)]
    return replicates.screen(table(spark, d, "lineitem"), rules).select(*LINE, "reason")


@query("c17_wide_projection", "SELECT o_custkey, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 100)::BIGINT END), 0)::BIGINT AS F, coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 100)::BIGINT END), 0)::BIGINT AS O FROM orders GROUP BY 1")
def c17(spark: SparkSession, d: str) -> DataFrame:
    """The wide columns are named, so the contract is the plan's own."""
    cents = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return cents.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.sum("cents")).na.fill(0, ["F", "O"])


@query("c18_coalesce_chain", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR ELSE 'none' END AS shown FROM orders")
def c18(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(" ")
    second = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", text.first_given(first, second, F.lit("none")).alias("shown"))


@query("d02_sheet_names", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def d02(spark: SparkSession, d: str) -> DataFrame:
    """Sheets are named with underscores and blanks, samples with hyphens."""
    sheets = table(spark, d, "nation").select("n_nationkey", assay.sheet_key(F.concat(F.lit(" run_"), F.col("n_regionkey").cast("string"), F.lit("_a "))).alias("k"))
    samples = table(spark, d, "region").select("r_name", assay.sheet_key(F.concat(F.lit("run-"), F.col("r_regionkey").cast("string"), F.lit("-a"))).alias("k"))
    return sheets.join(samples, "k").select("n_nationkey", "r_name")


@query("d29_visible_rows", "SELECT 'user' AS viewer, o_orderkey FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'nobody', o_orderkey FROM orders WHERE o_custkey = -1 UNION ALL SELECT 'administrator', o_orderkey FROM orders")
def d29(spark: SparkSession, d: str) -> DataFrame:
    """What a user, one without rows, and an administrator see."""
    rows = table(spark, d, "orders").withColumnRenamed("o_custkey", "user_id")
    seen = [dossier.visible(rows, user, every).select(F.lit(viewer).alias("viewer"), "o_orderkey") for viewer, user, every in (("user", "7", False), ("nobody", "-1", False), ("administrator", "-1", True))]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query(
    "d31_match_decoration",
    """
WITH p AS (SELECT p_partkey, s.side, i.index FROM part, (VALUES ('a'), ('b')) s(side), range(0, 3) i(index))
SELECT p_partkey, side, index, CASE WHEN side = 'a' AND index = p_partkey % 3 THEN p_partkey % 2 WHEN side = 'b' AND index = p_partkey % 2 THEN p_partkey % 3 END AS partner FROM p
""",
)
def d31(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey")
    peaks = part.withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("index", F.explode(F.sequence(F.expr("0L"), F.expr("2L"))))
    matches = part.select("p_partkey", (F.col("p_partkey") % 3).alias("a"), (F.col("p_partkey") % 2).alias("b"))
    return dossier.decorate(peaks, matches, ["p_partkey"])


@query("e01_group_collect", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def e01(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    return grouped.select("o_custkey", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("orders"))


@query("e02_array_sizes", "SELECT label, sum(len(embedding))::BIGINT AS n FROM embeddings GROUP BY 1")
def e02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.sum(F.size("embedding")).alias("n"))


@query("e03_distinct_media", "SELECT l_partkey, count(DISTINCT l_returnflag) AS media FROM lineitem GROUP BY 1")
def e03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("media"))


@query("e10_max_severity", "SELECT l_suppkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'FAIL' WHEN bool_or(l_returnflag = 'A') THEN 'WARN' ELSE 'PASS' END AS severity FROM lineitem GROUP BY 1")
def e10(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "WARN").otherwise("PASS")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(rollup.max_severity(severity).alias("severity"))


@query("e12_histogram", "SELECT event_type, least(floor(value / 50), 3)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def e12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("bin", F.least(F.floor(F.col("value") / 50), F.lit(3)).cast("long"))
    return rows.groupBy("event_type", "bin").agg(F.count("*").alias("n"))


@query("e16_coverage_ratio", "SELECT o_custkey, count_if(o_orderstatus = 'F') / count(*) AS covered FROM orders GROUP BY 1")
def e16(spark: SparkSession, d: str) -> DataFrame:
    counted = rollup.conditional_counts(table(spark, d, "orders"), {"f": F.col("o_orderstatus") == "F"}, ["o_custkey"])
    return counted.select("o_custkey", (F.col("f") / F.col("total")).alias("covered"))


@query(
    "e17_union_in_order",
    """
WITH i AS (SELECT o_custkey, o_orderkey, t.k, CASE t.k WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS v FROM orders, range(0, 2) t(k)),
f AS (SELECT o_custkey, v, min((o_orderkey, k)) AS place FROM i GROUP BY ALL)
SELECT o_custkey, string_agg(v, ',' ORDER BY place) AS items FROM f GROUP BY 1
""",
)
def e17(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("items"))
    return dossier.union_in_order(rows, "o_custkey", "items", ["o_orderkey"]).select("o_custkey", F.array_join("items", ",").alias("items"))


@query("e18_median", "SELECT l_suppkey, median(l_quantity) AS middle FROM lineitem GROUP BY 1")
def e18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("middle"))


@query("e22_impute_from_two", "SELECT l_partkey, l_suppkey, CASE WHEN count(*) = 2 THEN sum(l_quantity) / 2 END AS value FROM lineitem GROUP BY ALL")
def e22(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(replicates.imputed_concentration(F.col("l_quantity")).alias("value"))


@query("f01_first_per_key", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return ordered.first_per_key(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("f02_last_per_key", "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, max(o_orderkey) AS o_orderkey, min(o_orderkey) AS first_pos FROM orders GROUP BY 1")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return ordered.last_per_key(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("f08_argmin_with_ties", "SELECT l_suppkey, arg_min(l_partkey, (l_quantity, -l_extendedprice, l_orderkey, l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def f08(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("l_quantity", (-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min_by("l_partkey", order).alias("l_partkey"))


@query(
    "f13_heading_fill",
    """
WITH h AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, last_value(h IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM h
""",
)
def f13(spark: SparkSession, d: str) -> DataFrame:
    heading = F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))
    rows = table(spark, d, "lineitem").select(*LINE, *LINE_TIES)
    return ordered.fill_within(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", *LINE_TIES], F.lit(False), heading, "heading").select(*LINE, "heading")


@query(
    "f18_section_fill",
    """
WITH s AS (SELECT *, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w AS seg FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, last_value(CASE WHEN l_linestatus = 'O' THEN l_suppkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey, seg ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS medium FROM s
""",
)
def f18(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*LINE, *LINE_TIES)
    value = F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))
    return ordered.fill_within(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", *LINE_TIES], F.col("l_returnflag") == "R", value, "medium").select(*LINE, "medium")


@query("g02_custom_rank", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 99 END AS place FROM orders")
def g02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", ranking.rank_of(F.col("o_orderstatus"), ["P", "O"]).alias("place"))


@query("g05_top_popular", "SELECT l_partkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS pos FROM lineitem GROUP BY 1 QUALIFY pos <= 30")
def g05(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return ranking.top(counted, [F.desc("n"), F.col("l_partkey")], 30)


@query(
    "g08_by_completeness",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F')::INT + (o_totalprice > 100000)::INT DESC, o_orderkey) AS pos FROM orders",
)
def g08(spark: SparkSession, d: str) -> DataFrame:
    filled = evidence.information_count([F.when(F.col("o_orderstatus") == "F", "x"), F.when(F.col("o_totalprice") > 100000, "y")])
    return ranking.rank_within(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], [filled.desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "pos")


@query("g09_numeric_sort", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer")
def g09(spark: SparkSession, d: str) -> DataFrame:
    """Names whose numbers have no leading zeros sort by value."""
    rows = table(spark, d, "customer").withColumn("shown", F.concat(F.lit("Item "), F.col("c_custkey").cast("string"), F.lit(" x")))
    return ranking.rank_within(rows, ["c_nationkey"], [ranking.natural_key(F.col("shown"))]).select("c_custkey", "pos")


@query("g10_status_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS pos FROM orders")
def g10(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    order = [ranking.rank_of(status, ["ok", "partial", "failed"]), F.col("o_orderkey")]
    return ranking.rank_within(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], order).select("o_orderkey", "pos")


@query("g12_union_all", "SELECT 'c' AS origin, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def g12(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(o).alias("origin"), F.col(c).alias("nation")) for t, o, c in (("customer", "c", "c_nationkey"), ("supplier", "s", "s_nationkey"))]
    return parts[0].unionByName(parts[1]).groupBy("origin", "nation").agg(F.count("*").alias("n"))


@query(
    "g15_set_tests",
    """
WITH a AS (SELECT l_orderkey, list_distinct(list(l_returnflag) FILTER (WHERE l_linenumber % 2 = 1)) AS x, list_distinct(list(l_returnflag) FILTER (WHERE l_linenumber % 2 = 0)) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_intersect(coalesce(x, []), coalesce(y, []))) AS common, list_has_all(coalesce(y, []), coalesce(x, [])) AS inside FROM a
""",
)
def g15(spark: SparkSession, d: str) -> DataFrame:
    odd, even = (F.collect_set(F.when(F.col("l_linenumber") % 2 == i, F.col("l_returnflag"))) for i in (1, 0))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(odd.alias("x"), even.alias("y"))
    return rows.select("l_orderkey", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), (F.size(F.array_except("x", "y")) == 0).alias("inside"))


@query("g16_caps_by_source", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) <= 10")
def g16(spark: SparkSession, d: str) -> DataFrame:
    window = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(window).alias("n")).filter("n <= 10").drop("n")


@query("i03_visits", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS count FROM events GROUP BY 1")
def i03(spark: SparkSession, d: str) -> DataFrame:
    return counters.daily(table(spark, d, "events"), "ts", []).select(F.col("day").cast("string").alias("day"), "count")


@query(
    "i07_retention_sweep",
    f"""
WITH j AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'running' END AS status, o_orderdate + INTERVAL 90 DAY AS results, o_orderdate + INTERVAL 900 DAY AS gone FROM orders)
SELECT o_orderkey, CASE WHEN results > {NOW} THEN o_orderpriority END AS o_orderpriority, CASE WHEN results <= {NOW} AND status = 'complete' THEN 'expired' ELSE status END AS status FROM j WHERE gone > {NOW}
""",
)
def i07(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running")
    jobs = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", status.alias("status"), F.expr("o_orderdate + interval 90 days").alias("results"), F.expr("o_orderdate + interval 900 days").alias("gone"))
    return counters.sweep(jobs, {"results": ["o_orderpriority"]}, "gone", F.expr(NOW)).select("o_orderkey", "o_orderpriority", "status")


@query(
    "k02_served_cache",
    f"SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= {NOW} AND o_orderdate >= {NOW} - INTERVAL 400 DAY QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1) GROUP BY 1",
)
def k02(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("stored_at"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("download_allowed"))
    return counters.served(cache, F.expr(NOW), key="o_custkey", hours=400 * 24).select("o_custkey", "o_orderkey")


@query("k04_single_flight", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def k04(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return counters.to_fetch(table(spark, d, "orders"), kept, "o_custkey")


@query("k06_expiry_columns", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS input_expires, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS results_expire FROM orders")
def k06(spark: SparkSession, d: str) -> DataFrame:
    made = counters.with_expiry(table(spark, d, "orders"), "o_orderdate", {"input_expires": 7, "results_expire": 30})
    return made.select("o_orderkey", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("input_expires", "results_expire")))


@query("b05_status_cells", "SELECT o_orderkey, 'a:' || o_orderstatus || '; b:' || CASE WHEN o_custkey % 2 = 0 THEN 'ok' ELSE 'not_requested' END AS cell FROM orders")
def b05(spark: SparkSession, d: str) -> DataFrame:
    cell = exports.status_cell({"a": F.col("o_orderstatus"), "b": F.when(F.col("o_custkey") % 2 == 0, "ok")})
    return table(spark, d, "orders").select("o_orderkey", cell.alias("cell"))


@query(
    "h47_sample_problems",
    """
WITH s AS (SELECT s_suppkey, s_suppkey // 2 AS name, s_suppkey % 3 = 0 AS liquid FROM supplier), n AS (SELECT name, count(*) AS c FROM s GROUP BY 1)
SELECT name::VARCHAR || '-x' AS sample, p AS problem FROM s JOIN n USING (name), unnest(list_filter([
  CASE WHEN c > 1 THEN 'repeated_name' END, CASE WHEN liquid AND s_suppkey % 5 = 0 THEN 'missing_amount' END, CASE WHEN NOT liquid AND s_suppkey % 5 = 1 THEN 'wrong_amount' END,
  CASE WHEN s_suppkey % 7 = 0 THEN 'missing_standard' END, CASE WHEN s_suppkey % 11 = 0 THEN 'bad_volume' END], lambda x: x IS NOT NULL)) t(p)
""",
)
def h47(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    liquid = k % 3 == 0
    samples = table(spark, d, "supplier").select(
        F.concat(F.floor(k / 2).cast("string"), F.lit("-x")).alias("sample"),
        F.when(liquid, "liquid").otherwise("solid").alias("form"),
        F.when(liquid & (k % 5 != 0) | ~liquid & (k % 5 == 1), 1.0).alias("liquid_ml"),
        F.when(~liquid, 1.0).alias("solid_g"),
        F.when(k % 7 != 0, "50-00-0").alias("standard_cas"),
        F.when(k % 11 == 0, 0.0).otherwise(1.0).alias("system_ml"),
        F.lit(1.0).alias("spike_ul"),
    )
    return assay.validate_samples(samples)


@query(
    "l09_source_states",
    "SELECT o_orderkey, 'identity:' || CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'not_requested' END || ';spectra:' || CASE WHEN o_custkey % 2 = 0 THEN 'ready' ELSE 'no_data' END AS states FROM orders",
)
def l09(spark: SparkSession, d: str) -> DataFrame:
    state = dossier.states({"identity": F.when(F.col("o_orderstatus") == "F", 2).otherwise(0), "spectra": F.when(F.col("o_custkey") % 2 == 0, 1)}, {"spectra": F.lit("no_data")})
    some = F.filter(state, lambda s: s["chapter"].isin("identity", "spectra"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(some, lambda s: F.concat(s["chapter"], F.lit(":"), s["state"])), ";").alias("states"))


@query(
    "l18_split_by_matrix",
    "SELECT l_suppkey, count(*) AS n, CASE WHEN l_suppkey % 2 = 0 THEN 'wine' ELSE 'beer' END AS matrix FROM lineitem GROUP BY 1",
)
def l18(spark: SparkSession, d: str) -> DataFrame:
    stats = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("group")).agg(F.count("*").alias("n"))
    samples = table(spark, d, "supplier").select(F.col("s_suppkey").alias("group"), F.when(F.col("s_suppkey") % 2 == 0, "wine").otherwise("beer").alias("matrix"))
    return assay.split_by_matrix(stats, samples).select(F.col("group").alias("l_suppkey"), "n", "matrix")


@query(
    "p04_sample_summary",
    """
WITH l AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_partkey::VARCHAR END AS cas, l_quantity < 3 AS dropped FROM lineitem),
i AS (SELECT l_suppkey AS sheet, count(*) AS input, count_if(dropped) AS removed FROM l GROUP BY 1),
r AS (SELECT l_suppkey AS sheet, count(*) AS records, count(DISTINCT cas) FILTER (WHERE trim(cas) <> '') AS compounds, count_if(trim(cas) = '') AS without_cas FROM l WHERE NOT dropped GROUP BY 1),
p AS (SELECT l_suppkey AS sheet, count(*) AS n FROM l WHERE NOT dropped AND trim(cas) <> '' GROUP BY l_suppkey, cas),
m AS (SELECT sheet, sum(n - 1)::BIGINT AS merged FROM p GROUP BY 1),
g AS (SELECT l_suppkey AS sheet, count_if(l_returnflag = 'A') AS warn, count_if(l_returnflag = 'N' AND l_linestatus = 'F') AS review, count_if(l_returnflag = 'A' AND l_linenumber = 1) AS duplicate_hits,
  count_if(l_returnflag = 'N' AND l_linestatus = 'F' AND l_linenumber = 1) AS duplicate_peaks FROM lineitem GROUP BY 1)
SELECT i.sheet, input, removed, coalesce(records, 0) AS records, coalesce(compounds, 0) AS compounds, coalesce(without_cas, 0) AS without_cas, coalesce(merged, 0) AS merged, warn, review, 0::BIGINT AS fail, duplicate_hits, duplicate_peaks, 0::BIGINT AS anomalies,
  CASE WHEN review > 0 THEN 'REVIEW' WHEN warn > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM i LEFT JOIN r USING (sheet) LEFT JOIN m USING (sheet) LEFT JOIN g USING (sheet)
""",
)
def p04(spark: SparkSession, d: str) -> DataFrame:
    """Lines as a supplier's hits: few pieces are screened out, a returned part has no number."""
    cas = F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_partkey").cast("string"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sheet"), cas.alias("cas"), "l_quantity", "l_returnflag", "l_linestatus", "l_linenumber")
    severity = F.when(F.col("l_returnflag") == "A", "WARN").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "REVIEW")
    first = F.col("l_linenumber") == 1
    code = F.when(first & (severity == "WARN"), "REVIEW_DUPLICATE_HIT1").when(first & (severity == "REVIEW"), "REVIEW_DUPLICATE_PEAK").otherwise("OTHER")
    issues = rows.select("sheet", severity.alias("severity"), code.alias("code")).filter("severity is not null")
    screened = rows.withColumn("reason", F.when(F.col("l_quantity") < 3, "few"))
    return assay.sample_summary(screened.select("sheet", "cas", "reason"), issues)
