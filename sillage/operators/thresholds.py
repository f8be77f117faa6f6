"""Thresholds of scanned books: grades, source locators, groups of media, and which of them belong to a hit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hits without pages up to which they are broadcast to the thresholds; beyond, both are shuffled by number.
BROADCAST_IDS = 1_000_000

# How each kind of conflict is graded, and what an unknown kind counts as.
CONFLICT_GRADES = {
    "name_variant": "info",
    "likely_ocr_error": "review",
    "insufficient_extraction": "high",
    "identity_conflict": "high",
    "source_identity_error": "verified",
    "verified_name_variant": "verified",
}
OTHER_CONFLICT = "high"
# Groups of media in their order, with what shows each (contained, or the whole name); the first in LOOKED_UP counts.
MEDIUM_GROUPS = ["air", "water", "ethanolWater", "wine", "beer", "other"]
LOOKED_UP = [("air", ["空气"], []), ("ethanolWater", ["乙醇-水", "酒精-水"], []), ("wine", ["葡萄酒"], []), ("beer", ["啤酒"], []), ("water", ["水溶液"], ["水"])]


def grade(review_status: Column, review_flags: Column, confidence: Column) -> Column:
    """review if it needs one or is flagged, high for a sure association, else medium."""
    flagged = (F.coalesce(review_status, F.lit("")) == "needs_review") | (F.coalesce(F.size(review_flags), F.lit(0)) > 0)
    return F.when(flagged, "review").when(F.coalesce(confidence == "high", F.lit(False)), "high").otherwise("medium")


def conflict_grade(kind: Column) -> Column:
    out = F.lit(OTHER_CONFLICT)
    for name, level in CONFLICT_GRADES.items():
        out = F.when(kind == name, level).otherwise(out)
    return out


def block_of(record_id: Column) -> Column:
    """The block number that a record id ends with; null if it does not."""
    return F.nullif(F.regexp_extract(F.coalesce(record_id, F.lit("")), r"-b([0-9]+)$", 1), F.lit("")).cast("long")


def locator(page: Column, record_id: Column, corrections: Column) -> Column:
    """struct(page, block, record_id, verification): literal if every correction (reason, source_text, corrected_text) left the text as it was, corrected if one did not, null without any."""
    same = F.forall(corrections, lambda c: (F.coalesce(c["reason"], F.lit("")) == "source_verified_literal_unit") | F.coalesce(c["source_text"] == c["corrected_text"], F.lit(False)))
    kind = F.when(F.coalesce(F.size(corrections), F.lit(0)) > 0, F.when(same, "literal").otherwise("corrected"))
    return F.struct(page.alias("page"), block_of(record_id).alias("block"), record_id.alias("record_id"), kind.alias("verification"))


def medium_group(media: Column) -> Column:
    out = F.lit("other")
    for name, parts, whole in reversed(LOOKED_UP):
        out = F.when(F.exists(media, _shown_by(parts, whole)), name).otherwise(out)
    return out


def _shown_by(parts: list[str], whole: list[str]) -> Callable[[Column], Column]:
    """Whether a medium contains one of the parts or is one of the whole names."""

    def shown(m: Column) -> Column:
        out = F.lit(False)
        for c in [*(F.contains(m, F.lit(p)) for p in parts), *(m == w for w in whole)]:
            out = out | c
        return out

    return shown


def of_hits(hits: DataFrame, thresholds: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The hit and the key (id, or the columns named) of the thresholds that belong to each hit, once each.

    ``hits``: hit, pages, chunks, cas, names; ``thresholds``: the key, page, block, cas,
    subject, verified.  On one of the hit's pages a threshold belongs to it if it has its
    number; or if its subject is one of its names, where the subject is verified or the
    hit has no number; or, for a hit without a number, if its block is one of the hit's
    chunks, or the hit has none.  A hit without pages gets the thresholds of its number.

    Both sides are shuffled by page, once; pairs of a key that holds the page are not
    shuffled again.  Thresholds are dealt by number only if some hit needs it, which a
    count of these hits tells beforehand.
    """
    key = key or ["id"]
    t = thresholds.select(*key, *(c for c in ("page", "block") if c not in key), F.col("cas").alias("_cas"), "subject", "verified")
    cas = F.col("cas")
    same = F.coalesce(cas == F.col("_cas"), F.lit(False))
    named = F.coalesce(F.array_contains("names", F.col("subject")), F.lit(False)) & (F.coalesce("verified", F.lit(False)) | cas.isNull())
    # chunks that say nothing are null: all of a hit with a number, and empty ones
    chunked = cas.isNull() & (F.col("chunks").isNull() | F.coalesce(F.array_contains("chunks", F.col("block")), F.lit(False)))
    dealt = hits.select("hit", F.explode(F.array_distinct("pages")).alias("page"), F.when(cas.isNull() & (F.size("chunks") > 0), F.col("chunks")).alias("chunks"), "cas", "names")
    # merged at any size: after a broadcast the pairs would have to be shuffled
    found = dealt.join(t.hint("merge"), "page").filter(same | named | chunked).select("hit", *key)
    rest = hits.filter(F.coalesce(F.size("pages") <= 0, F.lit(True)) & cas.isNotNull()).select("hit", cas.alias("_cas"))
    count = rest.count()
    if count:
        found = found.unionByName((F.broadcast(rest) if count <= BROADCAST_IDS else rest).join(t, "_cas").select("hit", *key))
    return found.distinct()


def first_distinct(df: DataFrame, key: str, item: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` distinct items of each key in order, with their place."""
    first = df.filter(F.coalesce(F.trim(item) != "", F.lit(False))).groupBy(key, item).agg(F.min(F.struct(*order)).alias("_at"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_at")))
    return placed.filter(F.col("place") <= limit).select(key, item, "place")


def segments(text: Column, mark: str) -> Column:
    """The parts of a text from each match of ``mark`` up to the next; what stands before the first is left out."""
    parts = F.split(text, f"(?={mark})")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.rlike(f"^(?:{mark})"))


def last_named(df: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """The last name of each key that is not blank."""
    return df.filter(F.coalesce(F.trim(name) != "", F.lit(False))).groupBy(key).agg(F.max_by(name, F.struct(*order)).alias(name))


def same_order(tables: list[DataFrame], key: str, order: str) -> DataFrame:
    """(place, keys) where the tables do not have the same key in the same place; empty if all agree."""
    out = None
    for i, df in enumerate(tables):
        placed = df.select(F.col(order).alias("place"), F.col(key).alias(f"k{i}"))
        out = placed if out is None else out.join(placed, "place", "full_outer")
    keys = F.array(*(F.col(f"k{i}").cast("string") for i in range(len(tables))))
    return out.select("place", keys.alias("keys")).filter((F.size(F.array_distinct("keys")) > 1) | F.exists("keys", lambda k: k.isNull()))
