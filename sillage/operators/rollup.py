"""Aggregates: conditional counts, ordered concatenation, status lattices, gates, peaks and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["PASS", "WARN", "REVIEW", "FAIL"]


def conditional_counts(df: DataFrame, conditions: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """total and a count for each condition, in one pass."""
    return df.groupBy(*(keys or [])).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def ordered_unique(df: DataFrame, keys: list[str], value: str, order: list[str], sep: str = "\n", name: str = "joined") -> DataFrame:
    """Distinct non-blank values of a key joined in the order in which they first stand."""
    first = df.filter(F.trim(F.col(value)) != "").groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_o"))
    rows = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v")))).alias("_l"))
    return rows.select(*keys, F.array_join(F.transform("_l", lambda x: x["v"]), sep).alias(name))


def max_severity(severity: Column) -> Column:
    """Aggregate: the gravest of PASS, WARN, REVIEW, FAIL."""
    rank = F.max(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int"))


def lattice(status: Column) -> Column:
    """Aggregate: one status for a set of source statuses.

    ready if all are ok or no_data and one is ok, empty if all are no_data, partial if
    some are ok and others failed, else failed.
    """
    some_ok, some_bad, all_none = F.bool_or(status == "ok"), F.bool_or(~status.isin("ok", "no_data")), F.bool_and(status == "no_data")
    return F.when(all_none, "empty").when(some_ok & some_bad, "partial").when(some_ok, "ready").otherwise("failed")


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """metric, value, limit, kind and passed for each limit (kind min or max); a metric that is missing fails."""
    joined = limits.join(metrics, "metric", "left")
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    return joined.select("metric", "value", "limit", "kind", F.coalesce(ok, F.lit(False)).alias("passed"))


def merge_peaks(df: DataFrame, key: str, mz: str, intensity: str) -> DataFrame:
    """Peaks of each spectrum with equal m/z added up, invalid ones left out, in percent of the base peak.

    Valid: both numbers finite and positive.  Rounded half-even to six places.
    """
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    summed = df.filter(good(mz) & good(intensity)).groupBy(key, mz).agg(F.sum(intensity).alias("_i"))
    top = F.max("_i").over(Window.partitionBy(key))
    return summed.withColumn("_r", F.bround(F.col("_i") / top * 100, 6)).select(key, mz, F.col("_r").alias(intensity))


def cosine(matches: Column, a: Column, b: Column) -> Column:
    """Matched intensities' products over the norms of all intensities, rounded half-even to six places; null if a side is empty."""
    dot = F.aggregate(matches, F.lit(0.0), lambda s, m: s + m["a"] * m["b"])
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.bround(F.try_divide(dot, norm(a) * norm(b)), 6)


def merge_overlap(parts: Column, shortest: int = 35, longest: int = 220) -> Column:
    """Texts of an array folded into one, in order: a contained text is dropped, an overlap is joined, others go on a new line."""

    def fold(state: Column, nxt: Column) -> Column:
        tail, head = F.right(state, F.lit(longest)), F.left(nxt, F.lit(shortest))

        def size(end: Column) -> Column:
            """The longest overlap: from the head's first place in the tail, or sought size by size if that one does not fit."""
            at = F.instr(end, head)
            first = F.substr(end, at)
            sizes = F.sequence(F.lit(longest), F.lit(shortest), F.lit(-1))
            fits = F.filter(sizes, lambda n: (n <= F.length(end)) & (n <= F.length(nxt)) & (F.right(end, n) == F.left(nxt, n)))
            return F.when(at == 0, F.lit(None).cast("int")).when(F.startswith(nxt, first), F.length(first)).otherwise(F.get(fits, 0))

        def join(n: Column) -> Column:
            return F.when(n.isNotNull(), F.concat(state, F.substr(nxt, n + 1))).otherwise(F.concat(state, F.lit("\n"), nxt))

        # a transform of one value names it, so it is not worked out again where it is used
        joined = F.get(F.transform(F.transform(F.array(tail), size), join), 0)
        return F.when(state == "", nxt).when(F.contains(state, nxt), state).when(F.contains(nxt, state), nxt).otherwise(joined)

    return F.aggregate(parts, F.lit(""), fold)
