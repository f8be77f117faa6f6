"""Profiles from attempts that can fail: the last good one stays, and sources stand in for each other in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_good(attempts: DataFrame, keys: list[str], order: list[str], good: Column, payload: list[str], error: str) -> DataFrame:
    """keys, found, the payload of the last good attempt, stale, error and attempts.

    A failed attempt never takes a good payload away: it leaves it, with ``stale`` and the
    error of the last attempt.  A key without any good attempt is not found.  It is one
    aggregate that combines before its shuffle, and as such runs on a stream (complete
    mode) as it does on a table.  Ties in ``order`` are the caller's to exclude; null
    keys are keys.
    """
    at, ok = F.struct(*order), F.coalesce(good, F.lit(False))
    out = attempts.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.when(ok, at)).alias("_good"),
        F.max_by(F.struct(ok.alias("ok"), F.col(error).alias("error")), at).alias("_last"),
        F.count("*").alias("attempts"),
    )
    failed = ~F.col("_last.ok")
    return out.select(
        *keys,
        F.col("_good").isNotNull().alias("found"),
        *(F.col(f"_good.{c}").alias(c) for c in payload),
        (F.col("_good").isNotNull() & failed).alias("stale"),
        F.when(failed, F.coalesce("_last.error", F.lit("Source unavailable"))).alias("error"),
        "attempts",
    )


def first_source(profiles: DataFrame, keys: list[str], source: str, sources: list[str], payload: list[str]) -> DataFrame:
    """keys, source and payload of the first source in the given order that has found something; the sources before it as ``skipped``.

    A key that no source has gives a null source and payload.  Sources that aren't
    listed are not asked.
    """
    place = F.array_position(F.array(*map(F.lit, sources)), F.col(source))
    asked = profiles.filter(place > 0)
    found = F.when(F.col("found"), place)
    out = asked.groupBy(*keys).agg(F.min_by(F.struct(F.col(source).alias("source"), *payload), found).alias("_first"), F.min(found).alias("_place"), F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col(source).alias("name")))).alias("_all"))
    before = F.filter("_all", lambda s: F.col("_place").isNull() | (s["place"] < F.col("_place")))
    return out.select(*keys, "_first.source", *(F.col(f"_first.{c}").alias(c) for c in payload), F.array_join(F.transform(before, lambda s: s["name"]), ",").alias("skipped"))
