"""Dossiers: evidence filters, profiles, sensory records, book values and chapter states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.functions.measures import medium_category
from sillage.functions.text import split_terms
from sillage.operators.ordered import first_per_key

# The chapters of a dossier, in order.
CHAPTERS = ["identity", "thresholds", "sensory", "properties", "spectra", "biology", "activity", "structures"]


def optional_equal(df: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """Rows that equal every wanted value; None and ``all`` ask for nothing."""
    for column, value in wanted.items():
        if value is not None and value != "all":
            df = df.filter(F.col(column) == value)
    return df


def evidence_filter(df: DataFrame, *, book_only: bool = False, include_books: bool = True, medium: str = "all", types: list[str] | None = None) -> DataFrame:
    """Evidence by origin, category of medium, and type; an empty list of types leaves nothing."""
    keep = F.lit(True)
    if book_only:
        keep = keep & (F.col("origin") == "book")
    if not include_books:
        keep = keep & (F.col("origin") != "book")
    if medium != "all":
        keep = keep & (medium_category(F.col("medium")) == medium)
    if types is not None:
        keep = keep & (F.col("type").isin(types) if types else F.lit(False))
    return df.filter(F.coalesce(keep, F.lit(False)))


def profiles(df: DataFrame, key: str, order: str, *, limit: int, selected: str | None = None) -> DataFrame:
    """The first ``limit`` distinct keys in order, the selected one in the last place if it would miss it."""
    distinct = first_per_key(df.filter(F.col(key).isNotNull()).select(key, order), [key], [order])
    top = distinct.orderBy(order).limit(limit)
    if selected is None:
        return top
    inside = top.filter(F.col(key) == selected).limit(1).count() > 0
    if inside:
        return top
    return distinct.orderBy(order).limit(limit - 1).unionByName(distinct.filter(F.col(key) == selected))


def sensory_records(profile: DataFrame, key: str, sources: dict[str, dict[str, Column]]) -> DataFrame:
    """(key, source, kind, term): a row for each descriptor of each source's texts, each once, in order."""
    parts = [F.transform(F.array_distinct(split_terms(F.coalesce(column, F.lit("")), r"[,;|@]")), _tag(source, kind)) for source, kinds in sources.items() for kind, column in kinds.items()]
    rows = profile.select(key, F.posexplode(F.concat(*parts)).alias("pos", "r"))
    return rows.select(key, "pos", "r.source", "r.kind", "r.term")


def _tag(source: str, kind: str):
    return lambda t: F.struct(F.lit(source).alias("source"), F.lit(kind).alias("kind"), t.alias("term"))


def book_values(records: DataFrame) -> DataFrame:
    """Book thresholds with a value only where nothing speaks against it: no review flag, one number, no comparator, not a sample's."""
    value = F.filter("values", lambda v: v["role"] == "threshold")
    one = F.get(value, 0)
    sure = (F.size("review_flags") == 0) & (F.size(value) == 1) & one["high"].isNull() & one["low"].rlike(r"^[0-9.]+$")
    quality = F.when(F.size("review_flags") > 0, "review").when(F.col("association_confidence") == "high", "high").otherwise("medium")
    return records.withColumns({"value": F.when(sure, one["low"].try_cast("double")), "unit": one["unit"], "quality": quality})


def states(counts: dict[str, Column], statuses: dict[str, Column]) -> Column:
    """array of (chapter, state) in the fixed order: ready with records, else the source's own status, else not_requested."""
    listed = []
    for chapter in CHAPTERS:
        state = F.coalesce(F.when(counts[chapter] > 0, "ready") if chapter in counts else F.lit(None), statuses.get(chapter, F.lit(None).cast("string")), F.lit("not_requested"))
        listed.append(F.struct(F.lit(chapter).alias("chapter"), state.alias("state")))
    return F.array(*listed)


def chapters_covered(state: Column) -> Column:
    return F.size(F.filter(state, lambda s: s["state"] == "ready"))


def union_in_order(df: DataFrame, key: str, items: str, order: list[str]) -> DataFrame:
    """Distinct items of a key's arrays, in the order in which they first stand."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(items).alias("_i"))))
    return df.groupBy(key).agg(F.array_distinct(F.flatten(F.transform(listed, lambda x: x["_i"]))).alias(items))


def visible(jobs: DataFrame, user: str, is_admin: bool) -> DataFrame:
    """The rows that a user may see: their own, or all for an administrator."""
    return jobs if is_admin else jobs.filter(F.col("user_id") == user)


def decorate(peaks: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """Peaks of both sides (key, side, index) with the index of their partner, null if unmatched."""
    sides = matches.select(*key, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("index"), F.col("b").alias("partner")), F.struct(F.lit("b").alias("side"), F.col("b").alias("index"), F.col("a").alias("partner")))).alias("m"))
    return peaks.join(sides.select(*key, "m.*"), [*key, "side", "index"], "left")
