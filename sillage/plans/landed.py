"""Queries for parsers of landed service answers: payloads made from the tables, read back by the parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.operators.replicates import tags
from sillage.plans.registry import query, table
from sillage.sources import adapters, markup, services


def _answers(rows: DataFrame, key: str, payload: Column) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("key"), payload.alias("payload"))


def _json(**fields: Column | str | int | float) -> Column:
    """A JSON object of the fields."""
    return F.to_json(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items())))


def _object(**fields: Column | str | int | float) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))


@query(
    "o02_compound_identifiers",
    "SELECT p_partkey, p_partkey AS cid, p_name AS title, 'C' || p_size AS formula, CASE WHEN p_partkey % 2 = 0 THEN 'CO' ELSE 'CN' END AS smiles FROM part",
)
def o02(spark: SparkSession, d: str) -> DataFrame:
    smiles = {"SMILES": F.when(F.col("p_partkey") % 2 == 0, "CO"), "CanonicalSMILES": F.lit("CN")}
    one = _object(CID=F.col("p_partkey"), Title=F.col("p_name"), MolecularFormula=F.concat(F.lit("C"), F.col("p_size").cast("string")), **smiles)
    found = services.parse(_answers(table(spark, d, "part"), "p_partkey", _json(PropertyTable=_object(Properties=F.array(one)))), "compound_identifiers")
    return found.select(F.col("key").cast("long").alias("p_partkey"), "cid", "title", "formula", "smiles")


@query("o03_properties", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'density' ELSE 'vapor_pressure' END AS property, CASE WHEN p_partkey % 2 = 1 THEN p_size::DOUBLE END AS pressure FROM part")
def o03(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    said = F.when(even, F.lit("heavier than water")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" mmHg")))
    section = _object(TOCHeading=F.when(even, "Density").otherwise("Vapor Pressure"), Information=F.array(_object(Value=said)))
    rows = adapters.property_records(_answers(table(spark, d, "part"), "p_partkey", _json(Section=F.array(section))), {"Density": "density", "Vapor Pressure": "vapor_pressure"})
    return rows.select(F.col("key").cast("long").alias("p_partkey"), "property", F.when(F.col("property") == "vapor_pressure", F.col("value")).alias("pressure"))


@query("o05_descriptors", "SELECT p_partkey, p_partkey::VARCHAR AS cid, p_name AS common_name, lower(p_type) || ',sweet' AS flavors FROM part WHERE p_partkey > 0")
def o05(spark: SparkSession, d: str) -> DataFrame:
    payload = _json(pubchem_id=F.concat(F.lit("00"), F.col("p_partkey").cast("string")), common_name=F.col("p_name"), flavor_profile=F.concat(F.lower("p_type"), F.lit("@ sweet")))
    rows = adapters.descriptors(_answers(table(spark, d, "part").filter("p_partkey > 0"), "p_partkey", payload))
    return rows.select(F.col("key").cast("long").alias("p_partkey"), "cid", "common_name", F.array_join("flavor_profile", ",").alias("flavors"))


@query(
    "o07_food_links",
    "SELECT n_nationkey, c_custkey::VARCHAR AS food, c_mktsegment AS label FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def o07(spark: SparkSession, d: str) -> DataFrame:
    """A page for each nation that links to its customers, twice each."""
    link = lambda label: F.concat(F.lit('<A class="x" href="/food/'), F.col("c_custkey").cast("string"), F.lit('">'), label, F.lit("</a>"))
    pages = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(link(F.concat(F.lit("<b>"), F.col("c_mktsegment"), F.lit("</b>"))), link(F.lit("again"))))), "\n").alias("html"))
    found = markup.distinct_links(pages, "c_nationkey", "html")
    return found.select(F.col("c_nationkey").alias("n_nationkey"), F.regexp_extract("href", "/food/(.*)", 1).alias("food"), "label")


@query("o08_detail_tables", "SELECT s_suppkey, i::INTEGER AS pos, CASE i WHEN 0 THEN 'Name' WHEN 1 THEN s_name ELSE 'n & m' END AS first, CASE i WHEN 0 THEN 'Nation' WHEN 1 THEN s_nationkey::VARCHAR ELSE '' END AS second FROM supplier, range(0, 3) t(i)")
def o08(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>Name</th><th>Nation</th></tr><TR class='x'><td>"), F.col("s_name"), F.lit("</td><td> "), F.col("s_nationkey").cast("string"), F.lit("</td></TR>\n<tr><td>n &amp; m</td><td></td></tr></table>"))
    rows = markup.table_rows(table(spark, d, "supplier").select("s_suppkey", html.alias("html")), "s_suppkey", "html")
    return rows.select("s_suppkey", "pos", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"))


@query(
    "o15_candidates",
    """
SELECT p_partkey, pos, CASE WHEN (pos = 1) = (p_partkey % 2 = 0) THEN 'X1' ELSE 'X2' END AS id,
  CASE WHEN pos = 2 THEN 0 WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END AS rank, CASE WHEN p_partkey % 2 = 0 THEN 'ok' ELSE 'candidate' END AS status FROM part, (VALUES (1), (2)) t(pos)
""",
)
def o15(spark: SparkSession, d: str) -> DataFrame:
    """Even parts are found by their number in the first element, odd ones by name in the second."""
    number = F.concat((F.col("p_partkey") + 100).cast("string"), F.lit("-12-3"))
    even = F.col("p_partkey") % 2 == 0
    a = _object(id="X1", name="other", cas=F.when(even, number).otherwise(F.lit("1-1-1")))
    b = _object(id="X2", name=F.when(even, F.lit("another")).otherwise(F.upper("p_name")), cas=F.lit(""))
    part = table(spark, d, "part")
    targets = part.select(F.col("p_partkey").cast("string").alias("key"), F.lit("").alias("inchikey"), number.alias("cas"), F.lit("").alias("smiles"), F.col("p_name").alias("name"))
    rows = adapters.candidates(_answers(part, "p_partkey", _json(results=F.array(a, b))), targets)
    return rows.select(F.col("key").cast("long").alias("p_partkey"), "pos", "id", F.col("match.rank").alias("rank"), "status")


@query("o16_reactions", "SELECT 'R' || o_orderkey AS reaction, o_custkey || ',' || o_orderkey AS compounds, '1.1.1.' || o_orderkey % 7 AS ec_numbers FROM orders WHERE o_orderstatus = 'F'")
def o16(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    scanned = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" R"), k)).alias("id"), F.lit("a = b").alias("equation"), F.concat(F.col("o_custkey").cast("string"), F.lit("; "), k, F.lit(";")).alias("compounds"), F.concat(F.lit("EC 1.1.1."), (F.col("o_orderkey") % 7).cast("string")).alias("ec"), F.lit(None).cast("string").alias("enzymes"))
    rows = adapters.reactions(scanned)
    return rows.select("reaction", F.array_join("compounds", ",").alias("compounds"), F.array_join("ec_numbers", ",").alias("ec_numbers"))


@query("o17_proteins", "SELECT o_custkey, 'P' || o_orderkey AS accession, o_orderpriority AS name, 'g' || o_orderkey AS genes, 9606::BIGINT AS taxon FROM orders")
def o17(spark: SparkSession, d: str) -> DataFrame:
    """Each accession is listed twice in its answer."""
    k = F.col("o_orderkey").cast("string")
    one = _object(primaryAccession=F.concat(F.lit("P"), k), uniProtkbId=k, proteinDescription=_object(recommendedName=_object(fullName=_object(value=F.col("o_orderpriority")))), genes=F.array(_object(geneName=_object(value=F.concat(F.lit("g"), k)))), organism=_object(scientificName="Homo sapiens", taxonId=9606))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(one)).alias("l"))
    found = services.parse(_answers(rows, "o_custkey", F.to_json(F.struct(F.concat("l", "l").alias("results")))), "proteins")
    return found.select(F.col("key").cast("long").alias("o_custkey"), "accession", "name", F.array_join("genes", ",").alias("genes"), "taxon")


@query("o18_genes", "SELECT s_suppkey, s_suppkey::VARCHAR AS gene, s_name AS symbol, (s_nationkey + 1)::BIGINT AS taxon FROM supplier")
def o18(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    payload = F.concat(F.lit('{"result":{"uids":["'), k, F.lit('","0x"],"'), k, F.lit('":'), _json(name=F.col("s_name"), organism=_object(scientificname="x", taxid=F.col("s_nationkey") + 1)), F.lit("}}"))
    return adapters.genes(_answers(table(spark, d, "supplier"), "s_suppkey", payload)).select(F.col("key").cast("long").alias("s_suppkey"), "gene", "symbol", "taxon")


@query("o19_taxa", "SELECT n_nationkey, n_nationkey::BIGINT AS taxon, n_name AS name, 'a/b' AS lineage FROM nation")
def o19(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    payload = F.concat(F.lit('{"result":{"uids":["'), k, F.lit('"],"'), k, F.lit('":'), _json(scientificname=F.col("n_name"), lineage=F.lit("a; b ;")), F.lit("}}"))
    return adapters.taxa(_answers(table(spark, d, "nation"), "n_nationkey", payload)).select(F.col("key").cast("int").alias("n_nationkey"), "taxon", "name", F.array_join("lineage", "/").alias("lineage"))


@query("o20_studies", "SELECT c_nationkey, 'MTBLS' || c_custkey AS study FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 10")
def o20(spark: SparkSession, d: str) -> DataFrame:
    """Every second study is of another collection; the first ten of the right one stay."""
    two = F.array(_object(accession=F.concat(F.lit("MTBLS"), F.col("c_custkey").cast("string")), name="t"), _object(accession="OTHER", name="t"))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", two.alias("s")))), lambda x: x["s"])).alias("content"))
    found = services.parse(_answers(rows, "c_nationkey", F.to_json(F.struct("content"))), "studies")
    return found.select(F.col("key").cast("int").alias("c_nationkey"), "study")


@query("o21_assays", "SELECT l_suppkey, least(count(*), 100)::INTEGER AS kept, count(*)::INTEGER AS total FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def o21(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an AID do not count."""
    cells = _object(Cell=F.array(F.when(F.col("l_returnflag") != "R", F.col("l_orderkey").cast("string")).otherwise(F.lit("")), F.lit("x")))
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list(cells).alias("Row"))
    payload = _json(Table=_object(Columns=_object(Column=F.array(F.lit("AID"), F.lit("Name"))), Row=F.col("Row")))
    found = adapters.assays(_answers(rows, "l_suppkey", payload)).filter("total > 0")
    return found.select(F.col("key").cast("long").alias("l_suppkey"), F.size("assays").alias("kept"), "total")


@query("o22_activities", "SELECT l_orderkey, l_linenumber::VARCHAR || ':' || l_partkey AS target, CASE WHEN l_returnflag = 'R' THEN 'Ki' ELSE 'IC50' END AS measure, l_quantity::BIGINT::VARCHAR AS value FROM lineitem")
def o22(spark: SparkSession, d: str) -> DataFrame:
    one = _object(activity_id=F.col("l_linenumber"), target_pref_name=F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string")), standard_type=F.when(F.col("l_returnflag") == "R", "Ki"), type=F.lit("IC50"), value=F.col("l_quantity").cast("long").cast("string"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("activities"))
    found = services.parse(_answers(rows, "l_orderkey", F.to_json(F.struct("activities"))), "activities")
    return found.select(F.col("key").cast("long").alias("l_orderkey"), "target", "measure", "value")


@query("o23_interactions", "SELECT p_partkey, p_partkey AS interaction, p_name AS target_name, CASE WHEN p_size % 2 = 0 THEN 'Agonist' ELSE 'Channel' END AS action, '' AS affinity FROM part")
def o23(spark: SparkSession, d: str) -> DataFrame:
    one = _object(interactionId=F.col("p_partkey"), targetId=1, targetName=F.col("p_name"), action=F.when(F.col("p_size") % 2 == 0, "Agonist").otherwise(""), type="Channel")
    found = services.parse(_answers(table(spark, d, "part"), "p_partkey", F.to_json(F.array(one))), "ligand_interactions")
    return found.select(F.col("key").cast("long").alias("p_partkey"), "interaction", "target_name", "action", "affinity")


@query("o25_structures", "SELECT DISTINCT o_custkey, 'X' || o_orderkey % 5 AS pdb_id FROM orders")
def o25(spark: SparkSession, d: str) -> DataFrame:
    """Chains of one structure count once."""
    one = _object(identifier=F.concat(F.lit("x"), (F.col("o_orderkey") % 5).cast("string"), F.lit("_"), F.col("o_orderkey").cast("string")))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(one).alias("result_set"))
    return services.parse(_answers(rows, "o_custkey", F.to_json(F.struct("result_set"))), "experimental_structures").select(F.col("key").cast("long").alias("o_custkey"), "pdb_id")


@query("o26_predicted_structures", "SELECT p_partkey, 'AF-' || p_partkey AS model, p_retailprice AS plddt, 4 AS version FROM part")
def o26(spark: SparkSession, d: str) -> DataFrame:
    payload = _json(modelEntityId=F.concat(F.lit("AF-"), F.col("p_partkey").cast("string")), globalMetricValue=F.col("p_retailprice"), latestVersion=4)
    return services.parse(_answers(table(spark, d, "part"), "p_partkey", payload), "predicted_structures").select(F.col("key").cast("long").alias("p_partkey"), "model", "plddt", "version")


@query("o27_receptors", "SELECT s_suppkey, upper(s_name) AS accession, 'n' || s_nationkey AS family FROM supplier WHERE s_suppkey % 2 = 0")
def o27(spark: SparkSession, d: str) -> DataFrame:
    """A receptor of another accession is not the one that was asked for."""
    asked = table(spark, d, "supplier").select("s_suppkey", F.lower("s_name").alias("key"), _json(accession=F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.lit("else")), family=F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("payload"))
    found = services.parse(asked, "receptors").join(asked.select("s_suppkey", "key"), "key")
    return found.select("s_suppkey", "accession", "family")


@query(
    "l23_combined_statuses",
    """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_data' ELSE 'invalid_response' END AS a, CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'upstream_unavailable' END AS b,
  CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_partkey % 3 = 2 THEN 'partial' ELSE 'ok' END ELSE CASE WHEN p_partkey % 3 = 0 THEN 'partial' ELSE 'upstream_unavailable' END END AS status FROM part
""",
)
def l23(spark: SparkSession, d: str) -> DataFrame:
    part, m = table(spark, d, "part"), F.col("p_partkey") % 3
    first = _answers(part, "p_partkey", F.when(m == 0, '{"result_set": [{"identifier": "1abc_1"}]}').when(m == 1, '{"result_set": []}').otherwise("no json"))
    second = _answers(part, "p_partkey", F.when(F.col("p_size") % 2 == 0, '[{"modelEntityId": "x"}]'))
    both = services.combined({"a": services.statuses(first, "experimental_structures"), "b": services.statuses(second, "predicted_structures")})
    return both.select(F.col("key").cast("long").alias("p_partkey"), "a", "b", "status")


@query(
    "l24_by_reference",
    """
WITH r AS (SELECT l_partkey, l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS r, min(CASE WHEN l_returnflag = 'N' THEN l_suppkey END) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_orderkey, r, n FROM r WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) <= 6
""",
)
def l24(spark: SparkSession, d: str) -> DataFrame:
    info = table(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey", "l_returnflag").agg(F.min("l_suppkey").alias("v"))
    info = info.withColumn("name", F.lower("l_returnflag"))
    return services.by_reference(info, key="l_partkey", reference="l_orderkey", name="name", value="v", wanted=["r", "n"], needed=["r"])


@query(
    "c13_tags_of_documents",
    "SELECT doc_id, t AS tag FROM documents, unnest(list_filter([CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN n_chars > 1000 THEN 'long' END, CASE WHEN lang = 'de' THEN 'german' END], lambda x: x IS NOT NULL)) u(t)",
)
def c13(spark: SparkSession, d: str) -> DataFrame:
    rules = [("mail", F.col("text").contains("@")), ("long", F.col("n_chars") > 1000), ("german", F.col("lang") == "de")]
    return tags(table(spark, d, "documents"), rules).select("doc_id", "tag")
