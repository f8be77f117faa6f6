"""Queries for functions of single fields: normalisation, parsing, classes and concentrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.functions import clauses, measures, names, properties, text, vocabulary
from sillage.operators import evidence, ranking, replicates
from sillage.plans.registry import query, table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _case(modulus, *values):
    """The value in the place of partkey modulo the number of values."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col(modulus) % len(values) == i, v).otherwise(out)
    return out


@query("h01_normalise_term", "SELECT c_custkey, lower(c_name || ' ' || c_mktsegment) AS term FROM customer")
def h01(spark: SparkSession, d: str) -> DataFrame:
    """Full-width spaces, soft hyphens and runs of blanks."""
    return table(spark, d, "customer").select("c_custkey", text.normalise_term(F.concat(F.lit("　 "), F.upper("c_name"), F.lit(" \t­ "), F.col("c_mktsegment"))).alias("term"))


@query("h02_unaccent", "SELECT doc_id, md5(lower(strip_accents(coalesce(text, '')))) AS digest FROM documents")
def h02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.unaccent(F.coalesce("text", F.lit("")))).alias("digest"))


@query("h04_normalise_name", "SELECT p_partkey, lower(p_type || ' ' || p_name) AS name FROM part")
def h04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.normalise_name(F.concat(F.lit(" "), F.col("p_type"), F.lit(" \n "), F.upper("p_name"))).alias("name"))


@query("h05_registry_numbers", "SELECT p_partkey, (p_partkey + 100) || '-12-3,50-00-0' AS numbers FROM part")
def h05(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat((F.col("p_partkey") + 100).cast("string"), F.lit("-12-3"))
    said = F.concat(F.lit("see "), number, F.lit(" and "), number, F.lit(", also 50-00-0; not 1-2-3"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.registry_numbers(said), ",").alias("numbers"))


@query(
    "h07_structure_keys",
    """
WITH k AS (SELECT c_custkey, translate(lpad(c_custkey::VARCHAR, 14, '0'), '0123456789', 'ABCDEFGHIJ') AS b FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN b || '-ABCDEFGHIJ-N' END AS key, CASE WHEN c_custkey % 3 <> 0 THEN b END AS connectivity FROM k
""",
)
def h07(spark: SparkSession, d: str) -> DataFrame:
    block = F.translate(F.lpad(F.col("c_custkey").cast("string"), 14, "0"), "0123456789", "abcdefghij")
    key = F.concat(F.lit(" "), block, F.when(F.col("c_custkey") % 3 == 0, "-ABC-N").otherwise("-abcdefghij-n "))
    return table(spark, d, "customer").select("c_custkey", text.structure_key(key).alias("key"), text.connectivity(key).alias("connectivity"))


@query("h11_strict_number", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE END AS value FROM part")
def h11(spark: SparkSession, d: str) -> DataFrame:
    size, m = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    said = F.when(m == 0, size).when(m == 1, F.concat(F.lit(" "), size, F.lit(".5"))).when(m == 2, F.concat(F.lit("-"), size)).otherwise(F.concat(size, F.lit("e3")))
    return table(spark, d, "part").select("p_partkey", measures.strict_number(said).alias("value"))


@query(
    "h15_inferred_unit",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'mg/kg' WHEN 'N' THEN 'mg/m3' END AS unit FROM lineitem",
)
def h15(spark: SparkSession, d: str) -> DataFrame:
    medium = F.when(F.col("l_returnflag") == "A", "in Water").when(F.col("l_returnflag") == "N", "Air").otherwise("red wine")
    return table(spark, d, "lineitem").select(*LINE, measures.inferred_unit(medium).alias("unit"))


@query(
    "h16_medium_category",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'water' WHEN 'N' THEN 'air' ELSE CASE WHEN l_linestatus = 'O' THEN 'alcohol' ELSE 'other' END END AS category FROM lineitem",
)
def h16(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("l_linestatus") == "O", "Red WINE").otherwise("cheese")
    medium = F.when(F.col("l_returnflag") == "A", "in Water").when(F.col("l_returnflag") == "N", "Air").otherwise(other)
    return table(spark, d, "lineitem").select(*LINE, measures.medium_category(medium).alias("category"))


@query(
    "h18_cross_reference",
    "SELECT p_partkey, p_partkey % 3 = 1 AS is_reference FROM part",
)
def h18(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat((F.col("p_partkey") + 100).cast("string"), F.lit("-12-3"))
    m = F.col("p_partkey") % 3
    said = F.when(m == 0, F.concat(F.lit("Author (1980) d see "), own)).when(m == 1, F.lit("Author (1980) see 50-00-0")).otherwise(F.lit("Author (1980) d 0.5 mg/L as 50-00-0"))
    return table(spark, d, "part").select("p_partkey", evidence.cross_reference(said, own).alias("is_reference"))


@query(
    "h21_record_score",
    r"""
WITH t AS (SELECT doc_id, source, lower(coalesce(text, '')) AS x FROM documents),
c AS (SELECT *, (length(x) - length(replace(x, 'the', ''))) // 3 AS a FROM t),
s AS (SELECT *, CASE WHEN a > 0 THEN 75.0::DOUBLE + 4 * least(a - 1, 3) + CASE WHEN contains(left(x, 180), 'the') THEN 18 ELSE 0 END ELSE 0 END + CASE WHEN source = 'src3' THEN 145 ELSE 0 END AS s FROM c)
SELECT doc_id, CASE WHEN s > 0 THEN s + CASE WHEN regexp_matches(x, '阈[[:space:]]*值|嗅阈|觉察阈|识别阈|threshold|(m|n|μ|u)g/') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(x, '白酒|葡萄酒|啤酒|黄酒|果酒|酒精|乙醇') THEN 4 ELSE 0 END ELSE 0 END AS score FROM s
""",
)
def h21(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks, sources as their entities."""
    score = ranking.with_signs(ranking.score_terms(F.col("text"), [("the", 75.0)]), F.col("text"), F.array("source"), ["src3"])
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


@query(
    "h26_scan_cleanup",
    "SELECT p_partkey, p_size || 'μg/L，嗅阈值' AS plain FROM part",
)
def h26(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", clauses.clean(F.concat(F.col("p_size").cast("string"), F.lit(" u g/ L ， 嗅 闽值 "))).alias("plain"))


@query("h28_name_compatibility", "SELECT p_partkey, p_partkey % 3 <> 2 AS same FROM part")
def h28(spark: SparkSession, d: str) -> DataFrame:
    aliases = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("abc-1"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("Somethingol"))).otherwise(F.array(F.lit("another")))
    return table(spark, d, "part").select("p_partkey", names.compatible(F.lit("cis-3-Somethingol (ABC 1)"), aliases).alias("same"))


@query("h29_conflict_class", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'likely_scan_error' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'name_variant' ELSE 'identity_conflict' END AS class FROM part")
def h29(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    empty = F.array().cast("array<string>")
    read = F.when(m == 1, empty).when(m == 2, F.array(F.lit("trans-inventedol"))).otherwise(F.array(F.lit("quite other")))
    found = vocabulary.conflict(F.when(m == 0, "己醉").otherwise("庚酮"), read, F.when(m == 0, "己醇").otherwise("苯酚"), F.lit("inventedol"), [("醉", "醇")])
    return table(spark, d, "part").select("p_partkey", found.alias("class"))


@query(
    "h30_block_type",
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'chapter_heading' WHEN 1 THEN 'section_heading' WHEN 2 THEN 'compound_profile' WHEN 3 THEN 'threshold' WHEN 4 THEN 'references' ELSE 'paragraph' END AS block_type FROM part",
)
def h30(spark: SparkSession, d: str) -> DataFrame:
    said = _case("p_partkey", "第三章 酯类", "第 2 节 来源", "某酯，141-78-6，FEMA 2414", "水中嗅阈值很低", "参考文献", "没有别的")
    return table(spark, d, "part").select("p_partkey", clauses.block_type(said).alias("block_type"))


@query(
    "h32_medium",
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '模拟葡萄酒' WHEN 1 THEN '乙醇-水' WHEN 2 THEN '水' WHEN 3 THEN '可可粉' WHEN 4 THEN 'MSG溶液' ELSE '未明确' END AS medium FROM part",
)
def h32(spark: SparkSession, d: str) -> DataFrame:
    said = _case("p_partkey", "模型葡萄酒（pH 3.5）中", "10%vol酒精-水溶液中", "纯水 中", "可可粉中", "5 mmol/L的msg溶液中", "别处")
    return table(spark, d, "part").select("p_partkey", clauses.medium(said).alias("medium"))


@query(
    "h33_kind_and_route",
    """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'detection' WHEN 1 THEN 'recognition' WHEN 2 THEN 'odor' WHEN 3 THEN 'acceptance' WHEN 4 THEN 'taste' ELSE 'unspecified' END AS kind,
  CASE p_partkey % 6 WHEN 0 THEN 'orthonasal' WHEN 2 THEN 'retronasal' ELSE 'unspecified' END AS route FROM part
""",
)
def h33(spark: SparkSession, d: str) -> DataFrame:
    said = _case("p_partkey", "前鼻觉察阈值", "Recognition threshold", "后 鼻嗅阈 值", "消费者可以接受的阈值", "苦味物质的阈值", "别的")
    return table(spark, d, "part").select("p_partkey", clauses.kind(said).alias("kind"), clauses.route(said).alias("route"))


@query(
    "h35_review_flags",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ambiguous_unit' WHEN 1 THEN 'unknown_medium,missing_entity' WHEN 2 THEN 'suspicious_magnitude' ELSE '' END AS flags FROM part",
)
def h35(spark: SparkSession, d: str) -> DataFrame:
    said = _case("p_partkey", "水中嗅阈值 3 pg/L", "嗅阈值 3 μg/L", "水中嗅阈值 2000 mg/L", "水中嗅阈值 3 μg/L")
    entity = F.when(F.col("p_partkey") % 4 != 1, "50-00-0")
    flags = clauses.review_flags(clauses.medium(said), clauses.values(said), entity, F.lit(""), clauses.kind(said))
    return table(spark, d, "part").select("p_partkey", F.array_join(flags, ",").alias("flags"))


@query("h40_property_ids", "SELECT p_partkey, CASE WHEN p_partkey > 0 THEN p_partkey::VARCHAR END AS id FROM part")
def h40(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", properties.canonical_id(F.concat(F.lit("00"), F.col("p_partkey").cast("string"))).alias("id"))


@query(
    "h43_standard_concentration",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (l_quantity / 1000.0::DOUBLE) / CASE WHEN l_linestatus = 'O' THEN l_partkey % 7 + 1 + l_quantity / 1000.0::DOUBLE ELSE (l_partkey % 7 + 1)::DOUBLE END AS level FROM lineitem",
)
def h43(spark: SparkSession, d: str) -> DataFrame:
    level = replicates.standard_concentration(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_partkey") % 7 + 1, F.col("l_linestatus") == "O")
    return table(spark, d, "lineitem").select(*LINE, level.alias("level"))


@query(
    "h44_semiquantitation",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_partkey % 9 = 0 THEN 'missing_area' WHEN l_partkey % 9 = 1 THEN 'zero_area_not_quantifiable' WHEN l_partkey % 9 = 2 THEN 'missing_standard' ELSE 'quantified' END AS status,
  CASE WHEN l_partkey % 9 > 2 THEN l_extendedprice / l_quantity * 2.5::DOUBLE END AS value FROM lineitem
""",
)
def h44(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("l_partkey") % 9
    area = F.when(m == 1, 0.0).when(m > 0, F.col("l_extendedprice"))
    q = replicates.semiquantitate(area, F.when(m != 2, F.col("l_quantity")), F.lit(2.5))
    return table(spark, d, "lineitem").select(*LINE, q.alias("q")).select(*LINE, "q.status", "q.value")


@query(
    "h45_imputed_concentration",
    "SELECT l_partkey, CASE WHEN count(*) FILTER (WHERE l_quantity > 25) = 2 THEN sum(CASE WHEN l_quantity > 25 THEN l_quantity END) / 2 END AS value FROM lineitem GROUP BY 1",
)
def h45(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(replicates.imputed_concentration(F.when(F.col("l_quantity") > 25, F.col("l_quantity"))).alias("value"))


@query(
    "h46_back_calculation",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 2 = 0 AS agrees FROM lineitem",
)
def h46(spark: SparkSession, d: str) -> DataFrame:
    reported = F.col("l_extendedprice") / F.col("l_quantity") * 4 * F.when(F.col("l_partkey") % 2 == 0, 1.0005).otherwise(1.01)
    return table(spark, d, "lineitem").select(*LINE, replicates.back_calculated(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(4.0), reported).alias("agrees"))


@query(
    "h49_categories",
    "SELECT p_partkey, concat_ws(',', CASE WHEN contains(lower(p_type), 'economy') OR contains(lower(p_type), 'promo') THEN 'cheap' END, CASE WHEN contains(lower(p_name), 'cold') THEN 'cool' END) AS found FROM part",
)
def h49(spark: SparkSession, d: str) -> DataFrame:
    found = vocabulary.categories(F.array("p_name", "p_type"), {"cool": ["Cold"], "cheap": ["economy", "PROMO"]})
    return table(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("found"))


@query(
    "h50_translation",
    "SELECT p_partkey, replace(replace(p_name, 'cold', 'warm'), 'widget', 'gadget') AS name, CASE p_type WHEN 'ECONOMY' THEN 'low' ELSE p_type END AS type FROM part",
)
def h50(spark: SparkSession, d: str) -> DataFrame:
    name = vocabulary.replace_words(F.col("p_name"), [("cold", "warm"), ("widget", "gadget")])
    return table(spark, d, "part").select("p_partkey", name.alias("name"), vocabulary.translate_terms(F.array("p_type"), {"Economy": "low"})[0].alias("type"))


@query(
    "h52_labels",
    "SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[0-9]') THEN 'number' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'sentence' END) AS found FROM documents",
)
def h52(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.array_join(vocabulary.labels(F.col("text"), [("number", "[0-9]"), ("mail", "@"), ("sentence", "^[A-Z]")]), ","), F.lit("")).alias("found"))


@query("h53_sentences", "SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]'), lambda x: regexp_matches(x, '[^\\s]'))) AS sentences FROM documents")
def h53(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("h55_file_names", "SELECT p_partkey, regexp_replace(regexp_replace(trim(p_name || ' #/ ' || p_type || '?'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def h55(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.safe_file_name(F.concat("p_name", F.lit(" #/ "), "p_type", F.lit("?"))).alias("name"))


@query("h56_batch_lines", r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: regexp_matches(x, '[^\s]'))) AS lines FROM documents")
def h56(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.batch_lines(F.col("text"))).cast("long").alias("lines"))


@query("h58_bounds", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '≥' WHEN 1 THEN '≤' WHEN 2 THEN '>' WHEN 3 THEN '<' ELSE '' END || p_size AS bound FROM part")
def h58(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", clauses.bound(F.concat(_case("p_partkey", "不低于 ", "不高于", "大于 ", "小于", " "), F.col("p_size").cast("string"))).alias("bound"))


@query("c20_useful_terms", "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS useful FROM part")
def c20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.useful_term(_case("p_partkey", "50-00-0", "oil", "ab", "酸味")).alias("useful"))


@query("e08_cv_gate", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity > 30 AS out FROM lineitem")
def e08(spark: SparkSession, d: str) -> DataFrame:
    """Thirty plus a rounding error is not above thirty."""
    value = F.when(F.col("l_quantity") == 30, F.lit(30.0) + 3.5e-15).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").select(*LINE, replicates.above(value, 30.0).alias("out"))


@query("e20_information_count", "SELECT o_orderkey, 2 + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS n FROM orders")
def e20(spark: SparkSession, d: str) -> DataFrame:
    fields = [F.col("o_orderkey"), F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "x").when(F.col("o_orderstatus") == "O", " ")]
    return table(spark, d, "orders").select("o_orderkey", evidence.information_count(fields).alias("n"))
