"""Replicate measurements: duplicate resolution, completion to a full grid, and statistics.

Tables stay long (one measurement a row); only sinks pivot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.operators.ordered import numbered

ULPS = 16 * 2.220446049250313e-16


def screen(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """The first rule that a row breaks, in order; null if none."""
    reason = F.lit(None).cast("string")
    for label, broken in reversed(rules):
        reason = F.when(broken, label).otherwise(reason)
    return df.withColumn(name, reason)


def reconciled(df: DataFrame, name: str = "reason") -> DataFrame:
    """n_input, n_kept and n_removed of a screened table; raises if they do not add up."""
    counts = df.agg(F.count("*").alias("n_input"), F.count_if(F.col(name).isNull()).alias("n_kept"), F.count_if(F.col(name).isNotNull()).alias("n_removed"))
    ok = F.assert_true(F.col("n_input") == F.col("n_kept") + F.col("n_removed"))
    return counts.filter(ok.isNull())


def tags(df: DataFrame, rules: list[tuple[str, Column]], name: str = "tag") -> DataFrame:
    """A row for each rule that a row meets; rows that meet none give none."""
    return df.withColumn(name, F.explode(F.array_compact(F.array(*(F.when(met, label) for label, met in rules)))))


def resolve_duplicates(df: DataFrame, *, sample: str, key: str, order: list[str], distance: str, area: str, limit: float = 20.0) -> DataFrame:
    """One row for each (sample, key): which of its repeats stands for them, with what area and why.

    Rows of a key that follow each other in the sample's order form a run.  Within a run
    of two whose distances differ by at most ``limit`` the areas are added up and the
    lower distance stands; else the lower distance stands alone.  A longer run adds up
    the areas of those within ``limit`` of its lowest distance.  Of two runs that differ
    by more than ``limit`` the lower distance stands, else the larger area; of more, the
    largest area of those within ``limit`` of the lowest.  Ties go to the earlier row.
    Null distances count as infinite.
    """
    far = F.coalesce(F.col(distance), F.lit(float("inf")))
    rows = numbered(df.withColumn("_d", far), [sample], order, "_pos")
    rows = rows.withColumn("_run", F.col("_pos") - F.row_number().over(Window.partitionBy(sample, key).orderBy("_pos")))
    run = [sample, key, "_run"]
    low = F.min("_d").over(Window.partitionBy(*run))
    size = F.count("*").over(Window.partitionBy(*run))
    rows = rows.withColumn("_near", (F.col("_d") - low <= limit) | (F.col("_d") == low)).withColumn("_size", size)
    merged = F.sum(F.when(F.col("_near"), F.col(area))).alias("area")
    best = F.min_by(F.struct("_pos", F.col(distance).alias("distance"), F.col(area).alias("own")), F.struct("_d", "_pos")).alias("best")
    runs = rows.groupBy(*run).agg(best, merged, F.count("*").alias("size"), F.count_if("_near").alias("n_near"), F.min("_d").alias("d"))
    alone = (F.col("size") > 1) & (F.col("n_near") == 1)
    runs = runs.select(*run, F.col("best._pos").alias("pos"), "d", F.when(alone, F.col("best.own")).otherwise(F.col("area")).alias("area"), "size", "n_near")

    group = Window.partitionBy(sample, key)
    runs = runs.withColumn("n_runs", F.count("*").over(group)).withColumn("_low", F.min("d").over(group))
    near = (F.col("d") - F.col("_low") <= limit) | (F.col("d") == F.col("_low"))
    rank = F.when(near, F.struct(F.lit(0).alias("far"), (-F.col("area")).alias("minus"), F.col("pos").alias("pos"))).otherwise(F.struct(F.lit(1).alias("far"), F.col("d").alias("minus"), F.col("pos").alias("pos")))
    kept = runs.withColumn("_rank", rank).groupBy(sample, key).agg(
        F.min_by(F.struct("pos", "d", "area", "size", "n_near"), "_rank").alias("k"),
        F.first("n_runs").alias("n_runs"),
        F.sum("size").alias("n_rows"),
        F.count_if(near).alias("runs_near"),
    )
    action = (
        F.when(F.col("n_rows") == 1, "SINGLE")
        .when((F.col("n_runs") == 1) & (F.col("k.size") == 2) & (F.col("k.n_near") == 2), "MERGE_PAIR")
        .when((F.col("n_runs") == 1) & (F.col("k.size") == 2), "KEEP_LOWER_DISTANCE")
        .when(F.col("n_runs") == 1, "MERGE_RUN")
        .when(F.col("runs_near") > 1, "KEEP_LARGER_AREA")
        .otherwise("KEEP_LOWER_DISTANCE_APART")
    )
    return kept.select(sample, key, F.col("k.pos").alias("pos"), F.col("k.d").alias("distance"), F.col("k.area").alias("area"), action.alias("action"), "n_rows", "n_runs", (F.col("n_rows") - F.when(action.isin("MERGE_PAIR", "MERGE_RUN"), F.col("k.n_near")).otherwise(1)).alias("n_discarded"))


def complete_grid(df: DataFrame, *, keys: list[str], replicate: str, value: str, replicates: list) -> DataFrame:
    """Every (keys, replicate) of keys that have a valid value, with value and status.

    All replicates valid: measured.  One missing: imputed with the mean of the others.
    Fewer: removed (one) or dropped (none) for all replicates.  Valid is positive.
    The replicates of a key must be unique.
    """
    valid = df.filter(F.col(replicate).isin(replicates)).select(*keys, F.col(replicate).alias("replicate"), F.when(F.col(value) > 0, F.col(value)).alias("value"))
    per_key = valid.groupBy(*keys).agg(F.count("value").alias("n_valid"), F.sum("value").alias("_sum"), F.map_from_entries(F.collect_list(F.struct("replicate", "value"))).alias("_values"))
    grid = per_key.withColumn("replicate", F.explode(F.array(*map(F.lit, replicates))))
    own = F.try_element_at("_values", F.col("replicate"))
    full = len(replicates)
    out = F.when(own.isNotNull() & (F.col("n_valid") >= full - 1), own).when(F.col("n_valid") == full - 1, F.col("_sum") / (full - 1))
    status = F.when(F.col("n_valid") == full, "measured").when(F.col("n_valid") == full - 1, F.when(own.isNull(), "imputed").otherwise("measured")).when(F.col("n_valid") == 0, "dropped").otherwise("removed")
    return grid.select(*keys, "replicate", out.alias("value"), status.alias("status"), "n_valid")


def above(value: Column, threshold: float) -> Column:
    """Strictly above, beyond the rounding of the arithmetic."""
    return value - threshold > ULPS * F.greatest(F.lit(1.0), F.abs(value), F.lit(abs(threshold)))


def mean_sd_cv(df: DataFrame, keys: list[str], value: str, *, replicates: int = 3, cv_limit: float = 30.0) -> DataFrame:
    """Mean, sample standard deviation and CV in percent over complete groups.

    A group without values is ``all_missing``; one with some but not all raises.  A mean
    of 0 has no CV and is kept.
    """
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    ok = F.assert_true((F.col("n") == 0) | (F.col("n") == replicates), F.lit("a group has some of its replicates only"))
    stats = stats.filter(ok.isNull()).withColumn("cv", F.try_divide(F.col("sd") * 100, F.col("mean")))
    status = F.when(F.col("n") == 0, "all_missing").when(F.col("cv").isNull(), "no_cv").when(above(F.col("cv"), cv_limit), "above_limit").otherwise("retained")
    return stats.withColumn("status", status)


def share_of_total(df: DataFrame, keys: list[str], value: str, name: str = "share") -> DataFrame:
    """Each valid value in percent of its group's valid total; others null."""
    ok = F.when(F.col(value) > 0, F.col(value))
    total = F.sum(ok).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.try_divide(ok * 100, total))


def authority(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """For each key the fields of its best row in ``order``, and for each field whether its rows disagree."""
    rows = df.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_b"), *(F.coalesce(F.min(f) < F.max(f), F.lit(False)).alias(f"{f}_conflict") for f in fields))
    return rows.select(key, *(F.col(f"_b.{f}").alias(f) for f in fields), *(f"{f}_conflict" for f in fields))


def relative_error(value: Column, reference: Column) -> Column:
    return F.try_divide(F.abs(value - reference), F.abs(reference))


def standard_concentration(stock: Column, spike_ul: Column, system_ml: Column, include_spike: Column) -> Column:
    """Concentration of an internal standard in the system, from a stock spiked in; with or without the spike's volume."""
    spike = spike_ul / 1000.0
    return F.try_divide(stock * spike, F.when(include_spike, system_ml + spike).otherwise(system_ml))


def semiquantitate(area: Column, standard_area: Column, concentration: Column) -> Column:
    """struct(value, status): concentration by area ratio, response factor 1; a zero area can't be quantified."""
    value = F.try_divide(area, standard_area) * concentration
    status = F.when(area.isNull(), "missing_area").when(area == 0, "zero_area_not_quantifiable").when(standard_area.isNull() | (standard_area <= 0), "missing_standard").otherwise("quantified")
    return F.struct(F.when(status == "quantified", value).alias("value"), status.alias("status"))


def imputed_concentration(concentrations: Column) -> Column:
    """Aggregate: the mean of a standard's concentrations in the other replicates, if there are exactly two."""
    return F.when(F.count(concentrations) == 2, F.avg(concentrations))


def back_calculated(area: Column, standard_area: Column, concentration: Column, reported: Column, tolerance: float = 0.001) -> Column:
    """Whether a reported amount follows from its areas within the tolerance; null if it can't be worked out."""
    return relative_error(F.try_divide(area, standard_area) * concentration, reported) <= tolerance
