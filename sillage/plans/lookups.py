"""Queries for lookups, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.functions import measures, text
from sillage.operators import match, ordered, ranking, replicates, rollup
from sillage.plans.registry import query, table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("c01_exact_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_name) = 'building' OR lower(c_mktsegment) = 'building' OR CAST(c_custkey AS VARCHAR) = 'building'")
def c01(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    return match.exact_lookup(rows, " BUILDING ", ["key", "c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


@query("c02_fuzzy_lookup", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')")
def c02(spark: SparkSession, d: str) -> DataFrame:
    return match.fuzzy_lookup(table(spark, d, "part"), "Red", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_type")


_BULK = ["Brand#2", "", "  small ring ", "economy", "brand#17"]


@query(
    "c03_bulk_lookup_first",
    """
WITH q(line, q) AS (VALUES (0, 'brand#2'), (2, 'small ring'), (3, 'economy'), (4, 'brand#17')),
h AS (SELECT line, p.* FROM part p JOIN q ON lower(p_name) = q OR lower(p_brand) = q OR lower(p_type) = q),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY line, p_partkey) AS n FROM h)
SELECT line, p_brand, p_type, p_partkey FROM r WHERE n = 1
""",
)
def c03(spark: SparkSession, d: str) -> DataFrame:
    found = match.bulk_lookup(table(spark, d, "part"), _BULK, ["p_name", "p_brand", "p_type"], dedupe=["p_brand", "p_type"], order=["p_partkey"])
    return found.select("line", "p_brand", "p_type", "p_partkey")


@query("c05_type_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F')")
def c05(spark: SparkSession, d: str) -> DataFrame:
    """Coded rows by their code; uncoded ones (here P) only if all codes are asked for."""
    asked, codes = ["F"], ["F", "O"]
    coded = F.col("o_orderstatus").isin(codes)
    keep = F.col("o_orderstatus").isin(asked) if asked else F.lit(False)
    return table(spark, d, "orders").filter(F.when(coded, keep).otherwise(F.lit(set(asked) == set(codes)))).select("o_orderkey", "o_orderstatus")


@query("c09_facets", "SELECT array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS statuses FROM lineitem")
def c09(spark: SparkSession, d: str) -> DataFrame:
    facet = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.col(c)))), ",")
    return table(spark, d, "lineitem").agg(facet("l_returnflag").alias("flags"), facet("l_linestatus").alias("statuses"))


@query("c10_range_or_substring", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 20 UNION ALL SELECT p_partkey, p_size FROM part WHERE contains(CAST(p_size AS VARCHAR), '7')")
def c10(spark: SparkSession, d: str) -> DataFrame:
    from sillage.functions.spectra import peak_filter

    rows = table(spark, d, "part").select("p_partkey", "p_size")
    return rows.filter(peak_filter(F.col("p_size"), " 20-5 ")).unionAll(rows.filter(peak_filter(F.col("p_size"), "7")))


def _rules() -> list[tuple[str, F.Column]]:
    return [("element", F.col("l_returnflag") == "R"), ("quantity", F.col("l_quantity") < 5), ("discount", F.col("l_discount") >= 0.09), ("area", F.col("l_extendedprice") > 90000)]


@query(
    "c12_screen_reasons",
    """
WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'element' WHEN l_quantity < 5 THEN 'quantity' WHEN l_discount >= 0.09 THEN 'discount' WHEN l_extendedprice > 90000 THEN 'area' END AS reason FROM lineitem)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, (SELECT count(*) FROM s) AS n_input FROM s GROUP BY 1
""",
)
def c12(spark: SparkSession, d: str) -> DataFrame:
    screened = replicates.screen(table(spark, d, "lineitem"), _rules())
    total = replicates.reconciled(screened).select("n_input")
    counts = screened.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total))  # one row


@query("c13_review_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount = 0 THEN 'no_discount' END, CASE WHEN l_tax = 0 THEN 'no_tax' END], lambda x: x IS NOT NULL)) AS tag FROM lineitem) GROUP BY tag")
def c13(spark: SparkSession, d: str) -> DataFrame:
    return replicates.tags(table(spark, d, "lineitem"), [("no_discount", F.col("l_discount") == 0), ("no_tax", F.col("l_tax") == 0)]).groupBy("tag").agg(F.count("*").alias("n"))


@query(
    "d01_first_hit_join",
    """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS n FROM lineitem WHERE l_linenumber = 1)
SELECT o_orderkey, l_partkey, l_suppkey, n IS NOT NULL AS matched FROM orders LEFT JOIN h ON o_orderkey = l_orderkey AND n = 1
""",
)
def d01(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    out = match.first_hit(table(spark, d, "orders").select("o_orderkey"), hits, ["o_orderkey"], ["l_partkey", "l_suppkey"])
    return out.select("o_orderkey", "l_partkey", "l_suppkey", "matched")


@query("d03_lookup_default", "SELECT c_custkey, coalesce(n_name, '') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey")
def d03(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").filter("n_regionkey < 2")
    return table(spark, d, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("")).alias("n_name"))


@query(
    "d05_federated_left",
    """
WITH l AS (SELECT l_partkey, count(*) AS n_lines, min(l_suppkey) AS s FROM lineitem GROUP BY 1)
SELECT p_partkey, coalesce(n_lines, 0) AS n_lines, s_name FROM part LEFT JOIN l ON p_partkey = l_partkey LEFT JOIN supplier ON s = s_suppkey
""",
)
def d05(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_lines"), F.min("l_suppkey").alias("s_suppkey"))
    out = table(spark, d, "part").join(lines, "p_partkey", "left").join(table(spark, d, "supplier"), "s_suppkey", "left")
    return out.select("p_partkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "s_name")


@query(
    "d07_list_or_name_join",
    """
WITH e(pos, key, name) AS (VALUES (0, 5, 'src3'), (1, 17, 'src9'), (2, 3, 'src3')),
m AS (SELECT doc_id, pos FROM documents JOIN e ON doc_id % 20 = key UNION SELECT doc_id, pos FROM documents JOIN e ON source = name)
SELECT doc_id, min(pos) AS entity FROM m GROUP BY doc_id
""",
)
def d07(spark: SparkSession, d: str) -> DataFrame:
    entities = F.broadcast(spark.createDataFrame([(0, 5, "src3"), (1, 17, "src9"), (2, 3, "src3")], "pos int, key long, name string"))
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 20).alias("key"))
    both = docs.join(entities, "key").select("doc_id", "pos").unionAll(docs.join(entities, F.col("source") == F.col("name")).select("doc_id", "pos"))
    return both.groupBy("doc_id").agg(F.min("pos").alias("entity"))


@query(
    "d09_unambiguous_name",
    """
WITH n AS (SELECT floor(s_acctbal)::BIGINT % 400 AS name, min(s_suppkey) AS owner FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1)
SELECT c_custkey, owner FROM customer JOIN n ON c_custkey % 400 = name
""",
)
def d09(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select((F.floor("s_acctbal").cast("long") % 400).alias("name"), F.col("s_suppkey").alias("owner"))
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 400).alias("name"))
    return rows.join(match.unambiguous(names, "name", "owner"), "name").select("c_custkey", "owner")


@query(
    "d10_tiered_match",
    """
WITH q(i, q) AS (VALUES (0, '7'), (1, 'Brand#2'), (2, ' red widget'), (3, 'ring'), (4, 'nothing at all')),
t AS (SELECT p_partkey AS k, 1 AS tier, CAST(p_partkey AS VARCHAR) AS name FROM part UNION ALL SELECT p_partkey, 2, lower(p_name) FROM part),
m AS (SELECT i, tier, k FROM q JOIN t ON name = lower(trim(q)) UNION ALL SELECT i, 3, k FROM q JOIN t ON tier = 2 AND contains(name, lower(trim(q)))),
b AS (SELECT i, tier, count(DISTINCT k) AS n, min(k) AS k FROM m GROUP BY ALL),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY i ORDER BY tier) = 1)
SELECT q.i, q.q, tier, coalesce(n, 0) AS n_candidates, CASE WHEN tier < 3 AND n = 1 THEN k END AS match,
  CASE WHEN tier IS NULL THEN 'unmatched' WHEN tier = 3 THEN 'candidate' WHEN n > 1 THEN 'conflict' ELSE 'exact' END AS status FROM q LEFT JOIN f USING (i)
""",
)
def d10(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(0, "7"), (1, "Brand#2"), (2, " red widget"), (3, "ring"), (4, "nothing at all")], "i int, q string")
    return match.tiered_match(asked, table(spark, d, "part"), q="q", key="p_partkey", names=["p_name"]).select("i", "q", "tier", "n_candidates", "match", "status")


@query(
    "d13_graph_expand",
    """
WITH s AS (SELECT n_nationkey AS seed FROM nation WHERE n_regionkey <> 3),
a AS (SELECT DISTINCT seed, s_suppkey AS node FROM s JOIN supplier ON s_nationkey = seed),
b AS (SELECT DISTINCT seed, l_partkey AS node FROM a JOIN lineitem ON l_suppkey = node)
SELECT seed, 1 AS depth, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT seed, 2, count(*) FROM b GROUP BY 1
""",
)
def d13(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seed"), "n_regionkey")
    edges = [(table(spark, d, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("long")), "s_nationkey", "s_suppkey"), (table(spark, d, "lineitem"), "l_suppkey", "l_partkey")]
    return match.expand(seeds, edges, F.col("n_regionkey") != 3).groupBy("seed", "depth").agg(F.count("*").alias("n"))


def _prices(spark: SparkSession, d: str, suffix: str, part: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter(f"l_returnflag = '{part}'")
    return rows.select("l_partkey", F.col("l_orderkey").alias(f"order_{suffix}"), F.col("l_linenumber").alias(f"line_{suffix}"), F.col("l_extendedprice").alias(f"price_{suffix}"))


@query(
    "d16_tolerance_join",
    """
SELECT 'absolute' AS mode, a.l_partkey, a.l_orderkey AS order_a, a.l_linenumber AS line_a, b.l_orderkey AS order_b, b.l_linenumber AS line_b FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey
WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'N' AND abs(a.l_extendedprice - b.l_extendedprice) <= 100.0 + 1e-12
UNION ALL SELECT 'ppm', a.l_partkey, a.l_orderkey, a.l_linenumber, b.l_orderkey, b.l_linenumber FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey
WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'N' AND abs(a.l_extendedprice - b.l_extendedprice) <= (a.l_extendedprice + b.l_extendedprice) / 2 * 5000.0 * 1e-6 + 1e-12
""",
)
def d16(spark: SparkSession, d: str) -> DataFrame:
    a, b = _prices(spark, d, "a", "A"), _prices(spark, d, "b", "N")
    made = [match.tolerance_join(a, b, on=["l_partkey"], left="price_a", right="price_b", tolerance=t, ppm=p).withColumn("mode", F.lit(m)) for m, t, p in (("absolute", 100.0, False), ("ppm", 5000.0, True))]
    return made[0].unionByName(made[1]).select("mode", "l_partkey", "order_a", "line_a", "order_b", "line_b")


@query(
    "d17_greedy_match",
    """
WITH RECURSIVE p AS (SELECT vec_id, unnest(range(0, len(embedding))) AS place, unnest(embedding) AS v FROM embeddings),
k AS (SELECT * FROM p WHERE v > 0.2),
c AS (SELECT a.vec_id AS pair, a.place AS a, b.place AS b, abs(a.place - b.place) AS gap, -least(a.v, b.v) AS low FROM k a JOIN k b ON b.vec_id - 1 = a.vec_id AND abs(a.place - b.place) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY gap, low, a, b) AS i FROM c),
g AS (SELECT DISTINCT pair, 0::BIGINT AS i, []::BIGINT[] AS xs, []::BIGINT[] AS ys, false AS taken, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS gap, NULL::FLOAT AS low FROM r
  UNION ALL SELECT g.pair, r.i, CASE WHEN ok THEN list_append(g.xs, r.a) ELSE g.xs END, CASE WHEN ok THEN list_append(g.ys, r.b) ELSE g.ys END, ok, r.a, r.b, r.gap, r.low
  FROM g JOIN r ON r.pair = g.pair AND r.i = g.i + 1, LATERAL (SELECT NOT list_contains(g.xs, r.a) AND NOT list_contains(g.ys, r.b) AS ok))
SELECT pair, a, b FROM g WHERE taken
""",
)
def d17(spark: SparkSession, d: str) -> DataFrame:
    """Peaks (positions of large components) of neighbouring vectors of a label, matched one to one."""
    peaks = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "v")).filter("v > 0.2")
    a = peaks.select(F.col("vec_id").alias("pair"), F.col("at").cast("long").alias("a"), F.col("v").alias("va"))
    b = peaks.select((F.col("vec_id") - 1).alias("pair"), F.col("at").cast("long").alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, "pair").filter(F.abs(F.col("a") - F.col("b")) <= 2).withColumn("gap", F.abs(F.col("a") - F.col("b"))).withColumn("low", -F.least("va", "vb"))
    return match.matched_greedily(pairs.select("pair", "gap", "low", "a", "b"), ["pair"], a="a", b="b", order=["gap", "low"])


@query(
    "d20_range_overlay",
    "SELECT doc_id, CASE WHEN doc_id BETWEEN 10 AND 40 THEN 'first' WHEN doc_id BETWEEN 30 AND 80 THEN 'second' WHEN doc_id BETWEEN 500 AND 510 THEN 'third' END AS corrected FROM documents",
)
def d20(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(0, 10, 40, "first"), (1, 30, 80, "second"), (2, 500, 510, "third")], "pos int, lo long, hi long, corrected string")
    return match.range_overlay(table(spark, d, "documents").select("doc_id"), rules, at="doc_id", low="lo", high="hi", position="pos")


@query(
    "d23_gold_mismatch",
    """
WITH j AS (SELECT l.doc_id, d.doc_id AS there, quality, length(text) AS n FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 7 <> 0) d USING (doc_id))
SELECT doc_id, array_to_string(list_filter([CASE WHEN there IS NULL THEN 'missing' END, CASE WHEN there IS NOT NULL AND n < 400 THEN 'short' END, CASE WHEN there IS NOT NULL AND quality = 0 THEN 'rejected' END], lambda x: x IS NOT NULL), ';') AS issues
FROM j WHERE there IS NULL OR n < 400 OR quality = 0
""",
)
def d23(spark: SparkSession, d: str) -> DataFrame:
    actual = table(spark, d, "documents").filter("doc_id % 7 <> 0").select("doc_id", F.length("text").alias("n"))
    return match.mismatches(table(spark, d, "labels").select("doc_id", "quality"), actual, "doc_id", [("short", F.col("n") < 400), ("rejected", F.col("quality") == 0)])


@query(
    "g01_rank_year_value",
    "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY year(o_orderdate) DESC, o_totalprice, o_orderkey) AS pos FROM orders",
)
def g01(spark: SparkSession, d: str) -> DataFrame:
    order = [F.year("o_orderdate").desc(), F.col("o_totalprice"), F.col("o_orderkey")]
    return ranking.rank_within(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice"), ["o_orderpriority"], order).select("o_orderkey", "o_orderpriority", "pos")


_TERMS = [("the", 10.0), ("with", 7.5), ("onth", 4.0)]


@query(
    "g04_scored_topk",
    """
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents),
c AS (SELECT doc_id, x, (length(x) - length(replace(x, 'the', ''))) // 3 AS a, (length(x) - length(replace(x, 'with', ''))) // 4 AS b, (length(x) - length(replace(x, 'onth', ''))) // 4 AS c FROM t),
s AS (SELECT doc_id, CASE WHEN a > 0 THEN 10.0::DOUBLE + 4 * least(a - 1, 3) + CASE WHEN contains(left(x, 180), 'the') THEN 18 ELSE 0 END ELSE 0 END
  + CASE WHEN b > 0 THEN 7.5::DOUBLE + 4 * least(b - 1, 3) + CASE WHEN contains(left(x, 180), 'with') THEN 18 ELSE 0 END ELSE 0 END
  + CASE WHEN c > 0 THEN 4.0::DOUBLE + 4 * least(c - 1, 3) + CASE WHEN contains(left(x, 180), 'onth') THEN 18 ELSE 0 END ELSE 0 END AS score FROM c)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM s QUALIFY pos <= 20
""",
)
def g04(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "documents").select("doc_id", ranking.score_terms(F.col("text"), _TERMS).alias("score"))
    return ranking.top(scored, [F.desc("score"), F.col("doc_id")], 20)


@query(
    "g06_case_order_limit",
    "SELECT p_partkey, p_name, row_number() OVER (ORDER BY CASE WHEN p_name = 'red widget' THEN 0 ELSE 1 END, p_brand, p_partkey) AS pos FROM part WHERE p_name = 'red widget' OR starts_with(p_name, 'red') QUALIFY pos <= 500",
)
def g06(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "part").filter((F.col("p_name") == "red widget") | F.col("p_name").startswith("red"))
    order = [F.when(F.col("p_name") == "red widget", 0).otherwise(1), F.col("p_brand"), F.col("p_partkey")]
    return ranking.top(found, order, 500).select("p_partkey", "p_name", "pos")


@query(
    "g13_origin_dedupe",
    """
WITH u AS (SELECT 0 AS origin, l_partkey % 50 AS p, l_linenumber AS n, l_orderkey, l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 3 = 0
  UNION ALL SELECT 1, l_partkey % 50, l_linenumber, l_orderkey, l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 3 = 1 AND l_partkey % 50 > 20 OR l_orderkey % 11 = 0 AND l_partkey % 50 = 3),
f AS (SELECT *, first_value(origin) OVER (PARTITION BY p, n ORDER BY origin) AS f FROM u)
SELECT p, n, origin, count(*) AS rows FROM f WHERE origin = f GROUP BY ALL
""",
)
def g13(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("p"), F.col("l_linenumber").alias("n"), "l_orderkey")
    a = lines.filter("l_orderkey % 3 = 0").withColumn("origin", F.lit(0))
    b = lines.filter("l_orderkey % 3 = 1 and p > 20 or l_orderkey % 11 = 0 and p = 3").withColumn("origin", F.lit(1))
    return ordered.from_first_origin(a.unionByName(b), ["p", "n"], "origin", ["origin"]).groupBy("p", "n", "origin").agg(F.count("*").alias("rows"))


@query("g14_except_normalized", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: NOT list_contains(['red', 'ring'], w)), '|') AS rest FROM part")
def g14(spark: SparkSession, d: str) -> DataFrame:
    rest = ranking.except_normalised(F.split("p_name", " "), F.array(F.lit(" RED"), F.lit("Ring ")))
    return table(spark, d, "part").select("p_partkey", F.array_join(rest, "|").alias("rest"))


@query(
    "h06_checksum",
    """
WITH k AS (SELECT c_custkey, printf('%d-%02d-%d', 10 + c_custkey, c_custkey % 100, c_custkey % 10) AS number FROM customer),
r AS (SELECT *, reverse(replace(number, '-', '')) AS r FROM k)
SELECT c_custkey, list_sum(list_transform(range(2, length(r) + 1), lambda i: CAST(substr(r, CAST(i AS INTEGER), 1) AS BIGINT) * (i - 1)))::BIGINT % 10 = CAST(substr(r, 1, 1) AS BIGINT) AS valid FROM r
""",
)
def h06(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    number = F.concat_ws("-", (k + 10).cast("string"), F.lpad((k % 100).cast("string"), 2, "0"), (k % 10).cast("string"))
    return table(spark, d, "customer").select("c_custkey", text.checksum_ok(number).alias("valid"))


@query(
    "h08_identity_rank",
    """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'key' WHEN c_custkey % 5 = 1 THEN 'connectivity' WHEN c_custkey % 5 = 2 THEN 'number' WHEN c_custkey % 5 = 3 THEN 'structure' WHEN c_nationkey % 2 = 0 THEN 'name' ELSE 'none' END AS type,
  CASE WHEN c_custkey % 5 < 4 THEN 5 - c_custkey % 5 WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS rank, c_custkey % 5 < 4 AS verified FROM customer
""",
)
def h08(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("c_custkey") % 5
    block = "ABCDEFGHIJKLMN"
    a = {"key": F.lit(f"{block}-ABCDEFGHIJ-K"), "number": F.lit("141-78-6"), "structure": F.lit("CCO"), "name": F.lit("Ethyl  acetate ")}
    b = {
        "key": F.when(m == 0, f"{block}-ABCDEFGHIJ-K").when(m == 1, f"{block}-ZZZZZZZZZZ-K").otherwise(""),
        "number": F.when(m == 2, "141-78-6").otherwise(""),
        "structure": F.when(m == 3, "CCO").otherwise(""),
        "name": F.when(F.col("c_nationkey") % 2 == 0, "ethyl acetate").otherwise("x"),
    }
    rank = measures.identity_rank(a, b)
    return table(spark, d, "customer").select("c_custkey", rank.alias("r")).select("c_custkey", "r.type", F.col("r.rank").cast("long").alias("rank"), "r.verified")


@query(
    "h13_threshold_parse",
    """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 = 0 THEN 'd' WHEN l_linenumber % 4 = 1 THEN 'r' ELSE '' END AS k, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 3 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(k, '') AS type, CASE WHEN s = 0 THEN q / 1000.0::DOUBLE END AS value, CASE WHEN s = 0 THEN 'mg/L' END AS unit, CASE WHEN s = 0 THEN 'parsed' ELSE 'unparsed' END AS status FROM t
""",
)
def h13(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 4 == 0, "d ").when(F.col("l_linenumber") % 4 == 1, "r ").otherwise("")
    number = F.concat(F.lit("0."), F.lpad(F.col("l_quantity").cast("long").cast("string"), 3, "0"))
    s = F.col("l_suppkey") % 3
    entry = F.concat(F.lit("Miller et al. (1989) "), kind, F.when(s == 0, F.concat(number, F.lit(" mg/L"))).when(s == 1, F.concat(F.lit("< "), number)).otherwise(F.concat(number, F.lit(" - 9"))))
    return table(spark, d, "lineitem").select(*LINE, measures.threshold(entry).alias("t")).select(*LINE, "t.type", "t.value", "t.unit", "t.status")


@query(
    "h26_text_normalize",
    r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?i)<br\s*/?>|</p\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'),
  '[ \t]+', ' ', 'g'), ' ?\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS plain FROM pages
""",
)
def h26(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query(
    "e23_quality_gates",
    """
WITH m(metric, value) AS (SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'empty', count_if(trim(coalesce(text, '')) = '') FROM documents UNION ALL SELECT 'pages', count(*) FROM pages),
g(metric, "limit", kind) AS (VALUES ('documents', 100, 'min'), ('empty', 0, 'max'), ('pages', 1000000, 'min'), ('tables', 1, 'min'))
SELECT metric, value, "limit", kind, coalesce(CASE WHEN kind = 'min' THEN value >= "limit" ELSE value <= "limit" END, false) AS passed FROM g LEFT JOIN m USING (metric)
""",
)
def e23(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").agg(F.count("*").alias("documents"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))
    metrics = docs.select(F.expr("stack(2, 'documents', documents, 'empty', empty) as (metric, value)")).unionAll(table(spark, d, "pages").select(F.lit("pages").alias("metric")).groupBy("metric").agg(F.count("*").alias("value")))
    limits = spark.createDataFrame([("documents", 100, "min"), ("empty", 0, "max"), ("pages", 1000000, "min"), ("tables", 1, "min")], "metric string, limit int, kind string")
    return rollup.gates(metrics, limits)
