"""Instrument sheets to hits, internal standards, semi-quantities and matrix tables, all long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.functions.measures import exact_integer
from sillage.functions.text import normalise_term
from sillage.operators.replicates import semiquantitate, standard_concentration
from sillage.workspace import fresh

# Titles and headers of an instrument sheet.
PEAK_SECTION, SEARCH_SECTION = "[mc peak table]", "[ms similarity search results for spectrum process table]"
PEAK_HEADERS = ["peak#", "area", "ret. index"]
SEARCH_HEADERS = ["spectrum#", "hit #", "cas #", "name"]


def sections(rows: DataFrame, wanted: dict[str, tuple[str, list[str]]], *, sheet: str = "sheet", row: str = "source_row") -> DataFrame:
    """``rows`` with an array column for each wanted section (name: title and required headers): the header's names on rows below it, else null.

    A section starts at its title and ends before the next row whose first cell is in
    square brackets.  The header is the first row there that holds all required names.
    All sections are found in one pass over the sheet.
    """
    so_far = Window.partitionBy(sheet).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(sheet).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_cells", F.transform("cells", lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))))
    ends = {name: F.coalesce(F.get("_cells", F.lit(0)).rlike(r"^\[.*\]$"), F.lit(False)) | F.array_contains("_cells", title) for name, (title, _) in wanted.items()}
    inside = {name: F.last(F.when(ends[name], F.array_contains("_cells", title)), ignorenulls=True).over(so_far) & ~ends[name] for name, (title, _) in wanted.items()}
    out = out.withColumns({f"_in_{name}": F.coalesce(here, F.lit(False)) for name, here in inside.items()})
    header = {name: F.when(F.col(f"_in_{name}") & (F.size(F.array_except(F.array(*map(F.lit, required)), "_cells")) == 0), F.col("_cells")) for name, (_, required) in wanted.items()}
    out = out.withColumns({f"_head_{name}": F.first(found, ignorenulls=True).over(above) for name, found in header.items()})
    return out.select(*rows.columns, *(F.when(F.col(f"_in_{name}"), F.col(f"_head_{name}")).alias(name) for name in wanted))


def hits(rows: DataFrame, *, sheet: str = "sheet", row: str = "source_row") -> tuple[DataFrame, DataFrame]:
    """(records, issues): every peak with its first hit, the earliest row where there are several.

    Issues: a peak without a hit (WARN), repeated peak numbers or first hits (REVIEW),
    and sheets without a section or header (FAIL).  The rows are read once: what both
    tables come from is written under the checkpoint folder.
    """
    cell = lambda names, name: F.get("cells", (F.array_position(names, name) - 1).cast("int"))  # noqa: E731 - of repeated headers the first counts
    found = sections(rows, {"_peaks": (PEAK_SECTION, PEAK_HEADERS), "_search": (SEARCH_SECTION, SEARCH_HEADERS)}, sheet=sheet, row=row)
    read = found.select(
        sheet,
        F.col(row).alias("at"),
        F.row_number().over(Window.partitionBy(sheet).orderBy(row)).alias("_place"),
        F.col("_peaks").isNotNull().alias("_listed"),
        F.col("_search").isNotNull().alias("_searched"),
        exact_integer(cell("_peaks", "peak#")).alias("_number"),
        exact_integer(cell("_search", "spectrum#")).alias("_spectrum"),
        (exact_integer(cell("_search", "hit #")) == 1).alias("_first"),
        cell("_peaks", "area").alias("area"),
        cell("_peaks", "ret. index").alias("_own"),
        cell("_search", "ret. index").alias("_found"),
        cell("_search", "cas #").alias("cas"),
        cell("_search", "name").alias("name"),
        cell("_search", "retention index").alias("library"),
    )
    is_hit, is_peak = F.col("kind") == "hit", F.col("kind") == "peak"
    kinds = F.array(
        F.when(F.col("_listed") & F.col("_number").isNotNull(), "peak"),
        F.when(F.col("_searched"), F.when(F.col("_first") & F.col("_spectrum").isNotNull(), "hit").otherwise("searched")),
        F.when(F.col("_place") == 1, "sheet"),
    )
    told = read.withColumn("kind", F.explode(kinds)).filter("kind is not null")
    told = told.select(sheet, "at", "kind", F.when(is_peak, F.col("_number")).when(is_hit, F.col("_spectrum")).alias("peak"), "area", F.when(is_peak, F.col("_own")).otherwise(F.col("_found")).alias("index"), "cas", "name", "library")
    same = Window.partitionBy(sheet, "peak")
    told = told.withColumns({
        "first": F.min_by(F.struct("at", "index", "cas", "name", "library"), F.when(is_hit, F.col("at"))).over(same),
        "hits": F.count_if(is_hit).over(same),
        "peaks": F.count_if(is_peak).over(same),
        "start": F.min(F.when(is_peak, F.col("at"))).over(same),
    })
    folder, spark = fresh(rows.sparkSession, "hits"), rows.sparkSession
    told.write.parquet(folder)
    told = spark.read.schema(told.schema).parquet(folder)
    records = told.filter(is_peak & (F.col("hits") > 0)).select(sheet, "peak", "first.cas", "first.name", F.coalesce("first.index", "index").alias("measured_index"), F.col("first.library").alias("library_index"), "area", F.col("at").alias("peak_row"), F.col("first.at").alias("search_row"))
    issue = lambda df, severity, code, about: df.select(sheet, F.lit(severity).alias("severity"), F.lit(code).alias("code"), about.cast("string").alias("about"))
    sheets = told.groupBy(sheet).agg(F.count_if(is_peak).alias("_p"), F.count_if(F.col("kind").isin("hit", "searched")).alias("_s"))
    issues = (
        issue(told.filter(is_peak & (F.col("hits") == 0)), "WARN", "HIT1_NOT_FOUND", F.col("peak"))
        .unionByName(issue(told.filter(is_peak & (F.col("peaks") > 1) & (F.col("at") == F.col("start"))), "REVIEW", "REVIEW_DUPLICATE_PEAK", F.col("peak")))
        .unionByName(issue(told.filter(is_hit & (F.col("hits") > 1) & (F.col("at") == F.col("first.at"))), "REVIEW", "REVIEW_DUPLICATE_HIT1", F.col("peak")))
        .unionByName(issue(sheets.filter("_p = 0"), "FAIL", "FAIL_MISSING_PEAK_TABLE", F.lit(None)))
        .unionByName(issue(sheets.filter("_s = 0"), "FAIL", "FAIL_MISSING_SEARCH_RESULTS", F.lit(None)))
    )
    return records, issues


def sheet_key(name: Column) -> Column:
    """A sheet's or sample's name for joining: trimmed, underscores as hyphens."""
    return F.translate(F.trim(name), "_", "-")


def validate_samples(samples: DataFrame) -> DataFrame:
    """(sample, problem) of a sample table: repeated names, form and amount that disagree, missing standards, impossible volumes."""
    name = sheet_key(F.col("sample"))
    repeats = F.count("*").over(Window.partitionBy(name)) > 1
    problems = [
        ("repeated_name", repeats),
        ("missing_amount", F.when(F.col("form") == "liquid", F.col("liquid_ml").isNull()).otherwise(F.col("solid_g").isNull())),
        ("wrong_amount", F.when(F.col("form") == "liquid", F.col("solid_g").isNotNull()).otherwise(F.col("liquid_ml").isNotNull())),
        ("missing_standard", F.coalesce(F.trim("standard_cas"), F.lit("")) == ""),
        ("bad_volume", ~F.coalesce((F.col("system_ml") > 0) & (F.col("spike_ul") > 0), F.lit(False))),
    ]
    listed = samples.withColumn("_problems", F.array_compact(F.array(*(F.when(bad, label) for label, bad in problems))))
    return listed.select("sample", F.explode("_problems").alias("problem"))


def standards(records: DataFrame, samples: DataFrame, alternatives: list[tuple[str, str]], *, replicates: int = 3) -> DataFrame:
    """The internal standard of every sample: sample, group, area, detected_cas, status.

    measured: the configured compound; substituted: its approved alternative; imputed:
    the mean of exactly ``replicates`` - 1 others of the group; else missing.
    ``alternatives`` are pairs that may stand for each other.
    """
    areas = records.filter("area > 0").groupBy("sample", "cas").agg(F.max("area").alias("area"))
    swap = F.lit(None).cast("string")
    for a, b in alternatives:
        swap = F.when(F.col("standard_cas") == a, b).when(F.col("standard_cas") == b, a).otherwise(swap)
    own = samples.select("sample", "group", "standard_cas", swap.alias("_other"))
    exact = areas.select("sample", F.col("cas").alias("standard_cas"), F.col("area").alias("_exact"))
    other = areas.select("sample", F.col("cas").alias("_other"), F.col("area").alias("_sub"))
    found = own.join(exact, ["sample", "standard_cas"], "left").join(other, ["sample", "_other"], "left")
    found = found.withColumn("_area", F.coalesce("_exact", "_sub"))
    group = Window.partitionBy("group")
    donors, total = F.count("_area").over(group), F.sum("_area").over(group)
    status = F.when(F.col("_exact").isNotNull(), "measured").when(F.col("_sub").isNotNull(), "substituted").when(donors == replicates - 1, "imputed").otherwise("missing")
    area = F.when(F.col("_area").isNotNull(), F.col("_area")).when(donors == replicates - 1, total / (replicates - 1))
    cas = F.when(F.col("_exact").isNotNull(), F.col("standard_cas")).when(F.col("_sub").isNotNull(), F.col("_other"))
    return found.select("sample", "group", "standard_cas", area.alias("area"), cas.alias("detected_cas"), status.alias("status"))


def amounts(records: DataFrame, found: DataFrame, samples: DataFrame) -> DataFrame:
    """Semi-quantities (sample, group, cas, value, status) by each sample's standard and spiked concentration."""
    level = standard_concentration(F.col("stock_ug_ml"), F.col("spike_ul"), F.col("system_ml"), F.col("include_spike"))
    config = samples.select("sample", level.alias("_level"))
    joined = records.join(found.select("sample", "group", F.col("area").alias("_standard")), "sample").join(config, "sample")
    return joined.withColumn("_q", semiquantitate(F.col("area"), F.col("_standard"), F.col("_level"))).select("sample", "group", "cas", F.col("_q.value").alias("value"), F.col("_q.status").alias("status"))


def sample_summary(records: DataFrame, issues: DataFrame, *, sheet: str = "sheet") -> DataFrame:
    """A row for each sheet: what came in, was removed, is left and would merge, its issues by severity and kind, and its status.

    ``records`` has cas and may have reason (a record with one was screened out).
    compounds counts distinct numbers; without_cas the records whose number is null or
    blank; merged the records beyond the first of each number.  ``issues`` has severity
    and may have code; codes starting with FAIL are structural anomalies.
    """
    kept = F.col("reason").isNull() if "reason" in records.columns else F.lit(True)
    named = kept & (F.trim(F.coalesce("cas", F.lit(""))) != "")
    code = F.col("code") if "code" in issues.columns else F.lit(None).cast("string")
    counts = records.groupBy(sheet).agg(
        F.count("*").alias("input"),
        F.count_if(~kept).alias("removed"),
        F.count_if(kept).alias("records"),
        F.countDistinct(F.when(named, F.col("cas"))).alias("compounds"),
        F.count_if(kept & ~named).alias("without_cas"),
        F.count_if(named).alias("_named"),
    )
    kinds = {"duplicate_hits": code == "REVIEW_DUPLICATE_HIT1", "duplicate_peaks": code == "REVIEW_DUPLICATE_PEAK", "anomalies": code.startswith("FAIL")}
    graded = issues.groupBy(sheet).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("WARN", "REVIEW", "FAIL")), *(F.count_if(found).alias(name) for name, found in kinds.items()))
    out = counts.join(graded, sheet, "full_outer").na.fill(0)
    status = F.when(F.col("fail") > 0, "FAIL").when(F.col("review") > 0, "REVIEW").when(F.col("warn") > 0, "WARN").otherwise("PASS")
    return out.select(sheet, "input", "removed", "records", "compounds", "without_cas", (F.col("_named") - F.col("compounds")).alias("merged"), "warn", "review", "fail", *kinds, status.alias("status"))


def split_by_matrix(stats: DataFrame, samples: DataFrame) -> DataFrame:
    """Statistics with their group's matrix; a group of two matrices is an error, and one that no sample has is left out."""
    of = samples.groupBy("group").agg(F.min("matrix").alias("matrix"), F.countDistinct("matrix").alias("_n"))
    ok = F.assert_true(F.col("_n") == 1, F.lit("a group has samples of two matrices"))
    return stats.join(of.filter(ok.isNull()).drop("_n"), "group")


def normalised_title(cell: Column) -> Column:
    """A cell for comparing with titles, for sheets with full-width characters."""
    return normalise_term(cell)
