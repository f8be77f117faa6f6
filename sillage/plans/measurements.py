"""Queries for aggregates, ordered operators, replicate statistics, counters and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.functions import spectra
from sillage.operators import counters, ordered, replicates, rollup
from sillage.plans.registry import query, table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Lines can agree in all of LINE; what orders depend on is decided by these.
LINE_TIES = ["l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]


@query(
    "e04_conditional_counts",
    "SELECT count(*) AS total, count_if(event_type = 'click') AS clicks, count_if(event_type = 'error') AS errors, count_if(value > 50) AS large, count_if(event_type = 'click' AND value > 50) AS large_clicks FROM events",
)
def e04(spark: SparkSession, d: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return rollup.conditional_counts(table(spark, d, "events"), {"clicks": kind == "click", "errors": kind == "error", "large": value > 50, "large_clicks": (kind == "click") & (value > 50)})


@query(
    "e06_peak_merge",
    """
WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings),
s AS (SELECT vec_id, (place // 4)::BIGINT AS mz, sum(round(v * 1000)::BIGINT) AS i FROM p WHERE round(v * 1000) > 0 AND place // 4 > 0 GROUP BY ALL)
SELECT vec_id, mz, round_even(i::DOUBLE / max(i) OVER (PARTITION BY vec_id) * 100, 6) AS intensity FROM s
""",
)
def e06(spark: SparkSession, d: str) -> DataFrame:
    """Positions in fours stand for m/z; components, in thousandths, for intensities."""
    peaks = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "v"))
    peaks = peaks.select("vec_id", F.floor((F.col("at") + 1) / 4).cast("double").alias("mz"), F.round(F.col("v").cast("double") * 1000).alias("intensity"))
    return rollup.merge_peaks(peaks, "vec_id", "mz", "intensity").withColumn("mz", F.col("mz").cast("long"))


_GRID = """
WITH a AS (SELECT l_partkey, l_suppkey % 10 AS grp, (l_linenumber - 1) % 3 + 1 AS replicate, sum(round(l_extendedprice * 100)::BIGINT) AS cents FROM lineitem GROUP BY ALL),
k AS (SELECT l_partkey, grp, count(*) AS n_valid, sum(cents) AS total FROM a GROUP BY ALL),
g AS (SELECT k.*, r AS replicate FROM k, range(1, 4) t(r)),
f AS (SELECT g.l_partkey, g.grp, g.replicate, n_valid, cents, total FROM g LEFT JOIN a ON g.l_partkey = a.l_partkey AND g.grp = a.grp AND g.replicate = a.replicate),
c AS (SELECT l_partkey, grp, replicate, n_valid, CASE WHEN n_valid >= 2 THEN CASE WHEN cents IS NOT NULL THEN cents::DOUBLE ELSE total::DOUBLE / 2 END END AS value,
  CASE WHEN n_valid = 3 THEN 'measured' WHEN n_valid = 2 THEN CASE WHEN cents IS NULL THEN 'imputed' ELSE 'measured' END ELSE 'removed' END AS status FROM f)
"""


def replicate_of(line: str = "l_linenumber") -> Column:
    """The replicate, 1 to 3, that stands for a line number: lines are dealt to them in turn."""
    return (F.col(line) - 1) % 3 + 1


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid of every line."""
    areas = table(spark, d, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 10).alias("grp"), replicate_of().cast("long").alias("rep")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    return replicates.complete_grid(areas, keys=["l_partkey", "grp"], replicate="rep", value="cents", replicates=[1, 2, 3])


@query("f09_replicate_grid", _GRID + "SELECT * FROM c")
def f09(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


_STATS = """
, s AS (SELECT l_partkey, grp, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM c WHERE n_valid = 3 GROUP BY ALL)
SELECT l_partkey, grp, n, round(mean, 3) AS mean, round(sd, 3) AS sd, round(sd * 100 / mean, 6) AS cv, CASE WHEN sd * 100 / mean > 30 THEN 'above_limit' ELSE 'retained' END AS status FROM s
"""


@query("e07_mean_sd_cv", _GRID + _STATS)
def e07(spark: SparkSession, d: str) -> DataFrame:
    stats = replicates.mean_sd_cv(_grid(spark, d).filter("n_valid = 3"), ["l_partkey", "grp"], "value")
    return stats.select("l_partkey", "grp", "n", F.round("mean", 3).alias("mean"), F.round("sd", 3).alias("sd"), F.round("cv", 6).alias("cv"), "status")


@query(
    "e09_area_share",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(c * 100.0::DOUBLE / sum(c) OVER (PARTITION BY l_orderkey), 6) AS share FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem)",
)
def e09(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*LINE, F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    return replicates.share_of_total(rows, ["l_orderkey"], "c").select(*LINE, F.round("share", 6).alias("share"))


@query(
    "e11_status_rollup",
    """
WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'no_data' ELSE 'upstream_unavailable' END AS st,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 4 END AS sev FROM orders)
SELECT o_custkey, CASE WHEN bool_and(st = 'no_data') THEN 'empty' WHEN bool_or(st = 'ok') AND bool_or(st NOT IN ('ok', 'no_data')) THEN 'partial' WHEN bool_or(st = 'ok') THEN 'ready' ELSE 'failed' END AS status,
  ['PASS', 'WARN', 'REVIEW', 'FAIL'][max(sev)] AS severity FROM s GROUP BY 1
""",
)
def e11(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    rows = table(spark, d, "orders").select("o_custkey", F.when(s == "F", "ok").when(s == "O", "no_data").otherwise("upstream_unavailable").alias("st"), F.when(s == "F", "PASS").when(s == "O", "REVIEW").otherwise("FAIL").alias("sev"))
    return rows.groupBy("o_custkey").agg(rollup.lattice(F.col("st")).alias("status"), rollup.max_severity(F.col("sev")).alias("severity"))


@query(
    "e13_summary",
    "SELECT count(*) AS events, count(DISTINCT user_id) AS users, coalesce(count_if(CAST(ts AS DATE) = DATE '2024-01-15'), 0) AS today FROM events",
)
def e13(spark: SparkSession, d: str) -> DataFrame:
    today = F.to_date("ts") == F.lit("2024-01-15").cast("date")
    return table(spark, d, "events").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.coalesce(F.count_if(today), F.lit(0)).alias("today"))


@query(
    "e14_ordered_unique_concat",
    """
WITH f AS (SELECT l_suppkey, l_returnflag || l_linestatus AS v, min((l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus)) AS o FROM lineitem GROUP BY ALL)
SELECT l_suppkey, string_agg(v, '|' ORDER BY o) AS joined FROM f GROUP BY 1
""",
)
def e14(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("v", F.concat("l_returnflag", "l_linestatus"))
    return rollup.ordered_unique(rows, ["l_suppkey"], "v", ["l_orderkey", "l_linenumber", "l_partkey", *LINE_TIES], "|")


@query(
    "e15_cosine",
    """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, lead(vec_id) OVER w AS other, lead(embedding::DOUBLE[]) OVER w AS y FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, other, round(list_cosine_similarity(x, y), 5) AS similarity FROM e WHERE other IS NOT NULL
""",
)
def e15(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the next of its label."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    pairs = ordered.following(table(spark, d, "embeddings"), "label", "vec_id", "other").filter("other is not null")
    rows = pairs.select("vec_id", "other").join(vectors, "vec_id").join(vectors.select(F.col("vec_id").alias("other"), F.col("x").alias("y")), "other")
    both = F.zip_with("x", "y", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    dot = F.aggregate(both, F.lit(0.0), lambda s, m: s + m["a"] * m["b"])
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    return rows.select("vec_id", "other", F.round(F.try_divide(dot, norm("x") * norm("y")), 5).alias("similarity"))


@query("l10_compare_spectra")
def l10(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's positive components as a spectrum, compared with the next of its label."""
    places = F.transform("embedding", lambda v, i: F.struct((i * 7 + 40 + v).cast("double").alias("mz"), v.cast("double").alias("intensity")))
    vectors = table(spark, d, "embeddings").select("vec_id", spectra.normalise(places).alias("a"))
    pairs = ordered.following(table(spark, d, "embeddings"), "label", "vec_id", "other").filter("other is not null")
    rows = pairs.select("vec_id", "other").join(vectors, "vec_id").join(vectors.select(F.col("vec_id").alias("other"), F.col("a").alias("b")), "other")
    return rows.withColumn("c", spectra.compare(F.col("a"), F.col("b"), tolerance=0.1)).select("vec_id", "other", "c.similarity", "c.matched", "c.coverage_a", "c.coverage_b")


@query("e21_overlap_merge")
def e21(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows over the whole of every text, folded back into one; a null text stays null."""
    t, n = F.col("text"), F.length("text")
    starts = F.sequence(F.lit(1), F.greatest(n - 100, F.lit(1)), F.lit(200))
    windows = F.transform(starts, lambda at: F.substr(t, at, F.lit(300)))
    return table(spark, d, "documents").select("doc_id", F.when(t.isNotNull(), rollup.merge_overlap(windows)).alias("merged"), t.alias("whole"))


@query(
    "f03_occurrence_ids",
    "SELECT event_id, user_id || ':' || event_type || ':' || (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) AS id FROM events",
)
def f03(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.occurrence(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return rows.select("event_id", F.concat_ws(":", "user_id", "event_type", "occurrence").alias("id"))


@query(
    "f04_islands",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, event_type, island, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY ALL
""",
)
def f04(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered.islands(table(spark, d, "events"), ["user_id"], ["event_type"], ["ts", "event_id"])
    return rows.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


_RESOLVE = """
WITH r AS (SELECT l_suppkey, l_partkey % 200 AS cas, abs(l_quantity - 25) AS d, round(l_extendedprice * 100)::BIGINT AS area, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS pos FROM lineitem),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY l_suppkey, cas ORDER BY pos) AS run FROM r),
l AS (SELECT *, min(d) OVER (PARTITION BY l_suppkey, cas, run) AS low FROM i),
u AS (SELECT l_suppkey, cas, run, arg_min(pos, (d, pos)) AS pos, arg_min(area, (d, pos)) AS own, sum(CASE WHEN d - low <= 10 THEN area END) AS merged, count(*) AS size, count_if(d - low <= 10) AS n_near, min(d) AS d FROM l GROUP BY ALL),
v AS (SELECT *, CASE WHEN size > 1 AND n_near = 1 THEN own ELSE merged END AS area, min(d) OVER (PARTITION BY l_suppkey, cas) AS glow, count(*) OVER (PARTITION BY l_suppkey, cas) AS n_runs, sum(size) OVER (PARTITION BY l_suppkey, cas) AS n_rows,
  sum(CASE WHEN d - min_d <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey, cas) AS runs_near FROM (SELECT *, min(d) OVER (PARTITION BY l_suppkey, cas) AS min_d FROM u)),
k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY l_suppkey, cas ORDER BY CASE WHEN d - glow <= 10 THEN 0 ELSE 1 END, CASE WHEN d - glow <= 10 THEN -area ELSE d END, pos) = 1),
a AS (SELECT *, CASE WHEN n_rows = 1 THEN 'SINGLE' WHEN n_runs = 1 AND size = 2 AND n_near = 2 THEN 'MERGE_PAIR' WHEN n_runs = 1 AND size = 2 THEN 'KEEP_LOWER_DISTANCE' WHEN n_runs = 1 THEN 'MERGE_RUN' WHEN runs_near > 1 THEN 'KEEP_LARGER_AREA' ELSE 'KEEP_LOWER_DISTANCE_APART' END AS action FROM k)
SELECT l_suppkey, cas, pos, d AS distance, area::BIGINT AS area, action, n_rows::BIGINT AS n_rows, n_runs, (n_rows - CASE WHEN action IN ('MERGE_PAIR', 'MERGE_RUN') THEN n_near ELSE 1 END)::BIGINT AS n_discarded FROM a
"""


@query("f05_duplicate_resolution", _RESOLVE)
def f05(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*LINE, *LINE_TIES, (F.col("l_partkey") % 200).alias("cas"), F.abs(F.col("l_quantity") - 25).alias("d"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("area"))
    return replicates.resolve_duplicates(rows, sample="l_suppkey", key="cas", order=["l_orderkey", "l_linenumber", "l_partkey", *LINE_TIES], distance="d", area="area", limit=10.0)


@query(
    "f11_metadata_authority",
    """
SELECT l_partkey, arg_min(l_returnflag, (abs(l_quantity - 25), l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus)) AS l_returnflag, arg_min(l_linestatus, (abs(l_quantity - 25), l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus)) AS l_linestatus,
  count(DISTINCT l_returnflag) > 1 AS l_returnflag_conflict, count(DISTINCT l_linestatus) > 1 AS l_linestatus_conflict FROM lineitem GROUP BY 1
""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("d", F.abs(F.col("l_quantity") - 25))
    return replicates.authority(rows, "l_partkey", ["d", "l_orderkey", "l_linenumber", "l_suppkey", *LINE_TIES], ["l_returnflag", "l_linestatus"])


@query(
    "f12_context_inherit",
    """
WITH s AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations)
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, seg ORDER BY turn) AS asked_at FROM s
""",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    role = F.col("role")
    out = ordered.fill_within(table(spark, d, "conversations"), ["conv_id"], ["turn"], role == "system", F.when(role == "user", F.col("turn")), "asked_at")
    return out.select("conv_id", "turn", "asked_at")


@query(
    "f14_paragraph_group",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
s AS (SELECT *, CASE WHEN lag(line) OVER w IS NULL OR length(line) < 40 OR ends_with(lag(line) OVER w, '.') AND length(line) > 200 THEN 1 ELSE 0 END AS starts FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM s)
SELECT doc_id, block::BIGINT AS block, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM b GROUP BY ALL
""",
)
def f14(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    starts = before.isNull() | (F.length("line") < 40) | (before.endswith(".") & (F.length("line") > 200))
    flagged = lines.withColumn("_starts", starts)
    return ordered.blocks(flagged, ["doc_id"], ["pos"], F.col("_starts")).groupBy("doc_id", "block").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@query(
    "d27_retention_anti",
    """
WITH j AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'running' END AS status, 'r' || event_id AS result_path, 'i' || event_id AS input_path, ts + INTERVAL 7 DAY AS re, ts + INTERVAL 3 DAY AS ie, ts + INTERVAL 20 DAY AS del FROM events),
k AS (SELECT *, re <= TIMESTAMP '2024-01-25' OR ie <= TIMESTAMP '2024-01-25' AS gone FROM j WHERE del > TIMESTAMP '2024-01-25')
SELECT event_id, CASE WHEN re > TIMESTAMP '2024-01-25' THEN result_path END AS result_path, CASE WHEN ie > TIMESTAMP '2024-01-25' THEN input_path END AS input_path, CASE WHEN gone AND status = 'complete' THEN 'expired' ELSE status END AS status FROM k
""",
)
def d27(spark: SparkSession, d: str) -> DataFrame:
    ts, id_ = F.col("ts"), F.col("event_id").cast("string")
    jobs = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "complete").otherwise("running").alias("status"), F.concat(F.lit("r"), id_).alias("result_path"), F.concat(F.lit("i"), id_).alias("input_path"), (ts + F.expr("interval 7 days")).alias("re"), (ts + F.expr("interval 3 days")).alias("ie"), (ts + F.expr("interval 20 days")).alias("del"))
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return counters.sweep(jobs, {"re": ["result_path"], "ie": ["input_path"]}, "del", now).select("event_id", "result_path", "input_path", "status")


@query(
    "i01_counter_upsert",
    """
SELECT user_id, count(*) AS count, epoch_us(max(ts)) AS last_us, arg_max(event_type, (ts, event_id)) AS name, arg_max(other, (ts, event_id)) FILTER (WHERE other IS NOT NULL) AS other
FROM (SELECT *, CASE WHEN value > 20 THEN event_type END AS other FROM events) GROUP BY 1
""",
)
def i01(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("name"), F.when(F.col("value") > 20, F.col("event_type")).alias("other"))
    out = counters.upsert_counters(rows, "user_id", "ts", ["name"], ["other"], "event_id")
    return out.select("user_id", "count", F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "name", "other")


@query("i02_daily_counter", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY ALL")
def i02(spark: SparkSession, d: str) -> DataFrame:
    return counters.daily(table(spark, d, "events"), "ts", ["event_type"]).select(F.col("day").cast("string").alias("day"), "event_type", "count")


@query(
    "k01_cache_validity",
    """
WITH l(source, days) AS (VALUES ('click', 1), ('view', 7), ('error', 30))
SELECT event_id FROM events JOIN l ON event_type = source WHERE ts <= TIMESTAMP '2024-01-20' AND floor(epoch(TIMESTAMP '2024-01-20')) - floor(epoch(ts)) <= days * 86400 AND event_id % 4 <> 0
""",
)
def k01(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("source"), F.col("ts").alias("stored_at"), F.when(F.col("event_id") % 4 == 0, "upstream_unavailable").otherwise("ok").alias("status"))
    return counters.fresh(rows, {"click": 1, "view": 7, "error": 30}, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


@query(
    "i05_incremental_skip",
    "SELECT n_nationkey FROM nation WHERE NOT (n_nationkey % 2 = 0 AND n_regionkey = n_nationkey % 5)",
)
def i05(spark: SparkSession, d: str) -> DataFrame:
    incoming = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("version"))
    state = incoming.filter("n_nationkey % 2 = 0").select("n_nationkey", (F.col("n_nationkey") % 5).alias("version"))
    return counters.changed(incoming, state, "n_nationkey", ["version"]).select("n_nationkey")


@query("d28_cascade", "SELECT o_orderkey FROM orders SEMI JOIN (SELECT * FROM customer WHERE c_nationkey <> 7) ON o_custkey = c_custkey")
def d28(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "customer").filter("c_nationkey <> 7").select(F.col("c_custkey").alias("o_custkey"))
    return counters.survivors(table(spark, d, "orders"), parents, "o_custkey").select("o_orderkey")


@query("n01_daily_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY ALL")
def n01(spark: SparkSession, d: str) -> DataFrame:
    from sillage.streaming import counts

    return counts.drained(counts.daily_counts(counts.event_stream(spark, d)), "complete").select(F.col("day").cast("string").alias("day"), "event_type", "count")


@query("n02_dedupe_stream", "SELECT DISTINCT user_id, event_type FROM events")
def n02(spark: SparkSession, d: str) -> DataFrame:
    from sillage.streaming import counts

    return counts.drained(counts.once_per_key(counts.event_stream(spark, d), ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query(
    "n03_presence_stream",
    """
WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS opens FROM events),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e),
w AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS count FROM s GROUP BY user_id, n)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS "end", count FROM w WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""",
)
def n03(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    from sillage.streaming import counts

    found = counts.drained(counts.presence(counts.event_stream(spark, d)), "append")
    return found.select("user_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")), "count")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Screening, duplicate resolution, replicate completion and statistics, chained."""
    lines = table(spark, d, "lineitem").withColumns({"grp": F.col("l_suppkey") % 3, "rep": replicate_of().cast("long"), "cas": F.col("l_partkey") % 50, "d": F.abs(F.col("l_quantity") - 25)})
    kept = replicates.screen(lines, [("quantity", F.col("l_quantity") < 5), ("area", F.col("l_extendedprice") <= 0)]).filter("reason is null")
    kept = kept.withColumn("sample", F.concat_ws("-", "grp", "rep"))
    resolved = replicates.resolve_duplicates(kept.withColumnRenamed("l_extendedprice", "area"), sample="sample", key="cas", order=[*LINE, "l_quantity", "area", "l_returnflag", "l_linestatus"], distance="d", area="area")
    areas = resolved.select("cas", F.split("sample", "-")[0].alias("grp"), F.split("sample", "-")[1].cast("long").alias("rep"), "area")
    grid = replicates.complete_grid(areas, keys=["grp", "cas"], replicate="rep", value="area", replicates=[1, 2, 3])
    return replicates.mean_sd_cv(grid.filter("n_valid >= 2"), ["grp", "cas"], "value")
