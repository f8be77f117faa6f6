"""The measurement chain as entries: sheets to first hits, and replicate groups from repeats to statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.operators import assay, replicates, retrieval
from sillage.plans.measurements import _GRID, _RESOLVE, LINE, LINE_TIES
from sillage.plans.registry import query, table

_PLACES = "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus)"
_SHEETS = f"""
WITH p AS (SELECT l_suppkey AS sheet, {_PLACES} AS n, l_partkey, l_quantity::BIGINT AS q, l_returnflag AS flag, round(l_extendedprice * 100)::BIGINT::VARCHAR AS area FROM lineitem),
t AS (SELECT *, n - CASE WHEN q = 13 AND n > 1 THEN 1 ELSE 0 END AS peak, q % 7 <> 0 AS hit FROM p),
h AS (SELECT sheet, peak, arg_min(l_partkey, n) AS cas, count(*) + count_if(flag = 'R') AS hits FROM t WHERE hit GROUP BY ALL),
j AS (SELECT t.*, cas, hits FROM t LEFT JOIN h USING (sheet, peak))
SELECT sheet, 'record' AS kind, peak, cas::VARCHAR AS cas, area, count(*) AS times FROM j WHERE cas IS NOT NULL GROUP BY ALL
UNION ALL SELECT sheet, 'HIT1_NOT_FOUND', peak, NULL, NULL, count(*) FROM j WHERE cas IS NULL GROUP BY ALL
UNION ALL SELECT sheet, 'REVIEW_DUPLICATE_PEAK', peak, NULL, NULL, 1 FROM t GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT sheet, 'REVIEW_DUPLICATE_HIT1', peak, NULL, NULL, 1 FROM h WHERE hits > 1
"""


@query("l13_first_hits", _SHEETS)
def l13(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's lines as an instrument sheet: a peak for each line, some numbers twice, some without a hit, some with two first hits."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", *LINE_TIES)
    q, n = F.col("l_quantity").cast("long"), F.col("n")
    lines = table(spark, d, "lineitem").select(*LINE, *LINE_TIES).withColumn("n", F.row_number().over(order))
    lines = lines.withColumn("peak", (n - F.when((q == 13) & (n > 1), 1).otherwise(0)).cast("string"))
    sheet, area, cas = F.col("l_suppkey"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.col("l_partkey").cast("string")
    row = lambda at, *cells: F.struct(F.lit(at).cast("int").alias("at") if isinstance(at, int) else at.cast("int").alias("at"), F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells)).alias("cells"))
    peak, hit, again = F.col("peak"), q % 7 != 0, F.col("l_returnflag") == "R"
    titles = [(1, ["[MC Peak Table]"]), (2, ["# of peaks", "x"]), (3, ["Peak#", "Ret. Index", "Area"]), (10_000_000, ["[MS Similarity Search Results for Spectrum Process Table]"]), (10_000_001, ["Spectrum#", "Hit #", "CAS #", "Name", "Retention Index"])]
    made = [row(n + 10, peak, "1000", area), row(n + 400_000_000, peak, "2", "second", "name", "1005")]
    made += [F.when(hit, row(n * 2 + 20_000_000, peak, "1", cas, "name", "1005")), F.when(hit & again, row(n * 2 + 20_000_001, peak, "1", "later", "name", "1005"))]
    made += [F.when(n == 1, row(at, *cells)) for at, cells in titles]
    rows = lines.select(sheet.alias("sheet"), F.explode(F.array(*made)).alias("r")).filter("r is not null").select("sheet", F.col("r.at").alias("source_row"), "r.cells")
    records, issues = assay.hits(rows)
    found = records.groupBy("sheet", F.lit("record").alias("kind"), F.col("peak").cast("long").alias("peak"), "cas", "area").agg(F.count("*").alias("times"))
    none = F.lit(None).cast("string")
    told = issues.groupBy("sheet", F.col("code").alias("kind"), F.col("about").cast("long").alias("peak"), none.alias("cas"), none.alias("area")).agg(F.count("*").alias("times"))
    return found.unionByName(told)


_SAMPLES = "(SELECT *, (l_suppkey % 10) * 3 + (l_linenumber - 1) % 3 AS sample FROM lineitem)"
_GROUPS = (
    "WITH res AS (" + _RESOLVE.replace("l_suppkey", "sample").replace("FROM lineitem", f"FROM {_SAMPLES}") + "),\n"
    "a AS (SELECT cas AS l_partkey, sample // 3 AS grp, sample % 3 + 1 AS replicate, sum(area)::BIGINT AS cents FROM res GROUP BY ALL),"
    + _GRID.partition("),")[2]
    + "SELECT l_partkey AS cas, grp, replicate, n_valid, value, status FROM c"
)


@query("l15_replicate_groups", _GROUPS)
def l15(spark: SparkSession, d: str) -> DataFrame:
    """Samples of ten groups in three replicates: repeats of a number resolved in each sample, then completed over the replicates."""
    lines = table(spark, d, "lineitem").select(*LINE, *LINE_TIES, ((F.col("l_suppkey") % 10) * 3 + (F.col("l_linenumber") - 1) % 3).alias("sample"), (F.col("l_partkey") % 200).alias("cas"), F.abs(F.col("l_quantity") - 25).alias("d"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("area"))
    resolved = replicates.resolve_duplicates(lines, sample="sample", key="cas", order=["l_orderkey", "l_linenumber", "l_partkey", *LINE_TIES], distance="d", area="area", limit=10.0)
    areas = resolved.groupBy("cas", F.floor(F.col("sample") / 3).cast("long").alias("grp"), (F.col("sample") % 3 + 1).cast("long").alias("rep")).agg(F.sum("area").cast("long").alias("cents"))
    grid = replicates.complete_grid(areas, keys=["cas", "grp"], replicate="rep", value="cents", replicates=[1, 2, 3])
    return grid.select("cas", "grp", *(c for c in grid.columns if c not in ("cas", "grp")))


@query(
    "l03_hits_by_entity",
    "SELECT l_suppkey AS entity, max(l_quantity) AS score, string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS pages FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
)
def l03(spark: SparkSession, d: str) -> DataFrame:
    """Returned lines as hits of a supplier on the pages of orders."""
    hits = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("entity"), F.col("l_quantity").alias("score"), F.col("l_orderkey").cast("string").alias("page"), F.lit("").alias("text"))
    return retrieval.by_entity(hits, "entity").select("entity", "score", F.array_join("pages", ",").alias("pages"))
