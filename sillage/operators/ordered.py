"""Order-dependent operators: first and last of a key, runs, forward fill, occurrence numbers.

Every one takes its order as an argument; nothing depends on how rows happen to lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Cols = list[str]


def _tie(order: Cols) -> Column:
    return F.struct(*order)


def first_per_key(df: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """One row for each key: the first in ``order``.  An aggregate with map-side combine, so a hot key is no single task's work."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), _tie(order)).alias("_first"))
    return best.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(df.columns)


def last_per_key(df: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """One row for each key: the values of the last in ``order`` with ``first_pos``, where the key first stood (``order[0]``)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), _tie(order)).alias("_last"), F.min(order[0]).alias("first_pos"))
    return best.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest), "first_pos")


def occurrence(df: DataFrame, keys: Cols, order: Cols, name: str = "occurrence") -> DataFrame:
    """Running number of each key's rows, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def numbered(df: DataFrame, keys: Cols, order: Cols, name: str) -> DataFrame:
    """Running number of each key's rows, from 1, in a total order.

    If the first column of the order holds whole numbers, its values are cut in runs of
    2**16, each sorted apart and numbered on from the counts of the runs before it, so
    not even a key with most rows is sorted in one task.
    """
    if not isinstance(df.schema[order[0]].dataType, T.IntegralType):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = df.withColumn("_part", F.shiftright(F.col(order[0]).cast("long"), 16))
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*(F.col(k).alias(f"_at_{k}") for k in keys), F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))
    same = F.col("_part").eqNullSafe(F.col("_at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return rows.withColumn("_within", within).join(before, same).select(*df.columns, (F.col("_ahead") + F.col("_within")).cast("int").alias(name))


def islands(df: DataFrame, partition: Cols, kind: Cols, order: Cols, name: str = "island") -> DataFrame:
    """Number, within each partition and kind, of the run of neighbouring rows of one kind."""
    at = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    within = F.row_number().over(Window.partitionBy(*partition, *kind).orderBy(*order))
    return df.withColumn(name, at - within)


def fill_within(df: DataFrame, partition: Cols, order: Cols, reset: Column, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` so far, forgotten at each row where ``reset`` holds (before that row's own value)."""
    so_far = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_segment", F.sum(F.when(reset, 1).otherwise(0)).over(so_far))
    inner = Window.partitionBy(*partition, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.last(value, ignorenulls=True).over(inner)).drop("_segment")


def blocks(df: DataFrame, partition: Cols, order: Cols, starts: Column, name: str = "block") -> DataFrame:
    """Number of the block that a row is in, where ``starts`` (which may use lag over the same order) opens a new one."""
    so_far = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(so_far))


def neighbours(df: DataFrame, partition: Cols, order: Cols, anchor: Column, before: int = 1, after: int = 3, stop: Column | None = None) -> DataFrame:
    """Rows that are anchors, or at most ``before`` rows ahead of one, or ``after`` behind one without a ``stop`` row between."""
    window = Window.partitionBy(*partition).orderBy(*order)
    at = df.withColumn("_pos", F.row_number().over(window)).withColumn("_anchor", anchor)
    ahead = F.max(F.when(F.col("_anchor"), 1)).over(window.rowsBetween(0, before)).isNotNull()
    back = window.rowsBetween(Window.unboundedPreceding, 0)
    last_anchor = F.max(F.when(F.col("_anchor"), F.col("_pos"))).over(back)
    last_stop = F.max(F.when(stop & ~F.col("_anchor"), F.col("_pos"))).over(back) if stop is not None else F.lit(None).cast("int")
    behind = (F.col("_pos") - last_anchor <= after) & (last_stop.isNull() | (last_stop < last_anchor))
    return at.filter(F.lit(True)).withColumn("_keep", F.coalesce(ahead | behind, F.lit(False))).filter("_keep").drop("_pos", "_anchor", "_keep")


def from_first_origin(df: DataFrame, signature: Cols, origin: str, order: Cols) -> DataFrame:
    """Rows whose origin is the one that their signature came from first; repeats within that origin stay."""
    first = df.groupBy(*signature).agg(F.min_by(origin, _tie(order)).alias("_origin"))
    joined = df.join(first, signature)
    return joined.filter(F.col(origin) == F.col("_origin")).select(df.columns)


def following(df: DataFrame, key: str, at: str, name: str = "following", run: int = 100_000) -> DataFrame:
    """(key, at, following) of the distinct (key, at) of whole numbers: the next greater ``at`` of the key, null for its last.

    Values are cut in runs of ``run`` numbers, each sorted apart; the last of a run looks
    up the first of the key's next run, so not even a key with most rows is sorted in
    one task.
    """
    rows = df.select(key, at).filter(F.col(at).isNotNull()).distinct().withColumn("_run", F.floor(F.col(at) / run))
    firsts = rows.groupBy(key, "_run").agg(F.min(at).alias("_first"))
    after = firsts.select(key, "_run", F.lead("_first").over(Window.partitionBy(key).orderBy("_run")).alias("_after"))
    within = rows.withColumn("_next", F.lead(at).over(Window.partitionBy(key, "_run").orderBy(at)))
    joined = within.join(after, within[key].eqNullSafe(after[key]) & (within["_run"] == after["_run"]))
    return joined.select(within[key], within[at], F.coalesce("_next", "_after").alias(name))
