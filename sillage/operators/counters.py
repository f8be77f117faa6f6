"""Counters, incremental loads and retention, as aggregates and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_counters(events: DataFrame, key: str, ts: str, latest: list[str], keep: list[str], tie: str) -> DataFrame:
    """What a row-by-row upsert would leave: count, last time, the last value of ``latest`` and the last non-null of ``keep``; blank keys are ignored."""
    good = events.filter(F.coalesce(F.trim(F.col(key).cast("string")) != "", F.lit(False)))
    at = F.struct(ts, tie)
    parts = [F.count("*").alias("count"), F.max(ts).alias("last_ts")]
    parts += [F.max_by(c, at).alias(c) for c in latest]
    parts += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in keep]
    return good.groupBy(key).agg(*parts)


def daily(events: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("day"), *keys).agg(F.count("*").alias("count"))


def sweep(jobs: DataFrame, expires: dict[str, list[str]], delete: str, now: Column, status: str = "status") -> DataFrame:
    """Jobs after a retention sweep: columns are nulled when their expiry has passed, complete jobs whose results went become ``expired``, and rows past ``delete`` are gone."""
    out = jobs.filter(F.col(delete) > now)
    gone = F.lit(False)
    for expiry, columns in expires.items():
        past = F.col(expiry) <= now
        gone = gone | past
        out = out.withColumns({c: F.when(~past, F.col(c)) for c in columns})
    return out.withColumn(status, F.when(gone & (F.col(status) == "complete"), "expired").otherwise(F.col(status)))


def survivors(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there: a cascade's result."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def changed(incoming: DataFrame, state: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Incoming libraries that the state does not have in this version."""
    return incoming.join(state.select(key, *version), [key, *version], "left_anti")


def fresh(cache: DataFrame, lifetimes: dict[str, int], now: Column, *, source: str = "source", ts: str = "stored_at", persisted: tuple[str, ...] = ("ok", "no_data", "candidate")) -> DataFrame:
    """Cache rows that may be served: a known source, a status that is kept, not from the future, and not older than the source's days."""
    days = F.lit(None).cast("int")
    for name, n in lifetimes.items():
        days = F.when(F.col(source) == name, n).otherwise(days)
    at, now = F.col(ts).cast("timestamp"), now.cast("timestamp")
    # ages count whole seconds, but what is a part of a second ahead is from the future too
    return cache.filter(F.col("status").isin(*persisted) & (at <= now) & (F.unix_seconds(now) - F.unix_seconds(at) <= days * 86400))


def served(cache: DataFrame, now: Column, *, key: str = "key", ts: str = "stored_at", hours: Column | int = 24, allowed: str = "download_allowed") -> DataFrame:
    """The latest row of each key that may be kept (its licence allows it) and is not older than its hours."""
    hours = hours if isinstance(hours, Column) else F.lit(hours)
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp"))
    good = cache.filter(F.col(allowed) & (age >= 0) & (age <= hours * 3600))
    rest = [c for c in cache.columns if c != key]
    return good.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def to_fetch(requests: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Distinct requested keys that are not kept: each is fetched once however often it is asked for."""
    return requests.select(key).filter(F.col(key).isNotNull()).distinct().join(kept.select(key), key, "left_anti")


def with_expiry(rows: DataFrame, since: str, days: dict[str, int]) -> DataFrame:
    """``rows`` with a time of expiry for each name, so many days after ``since``."""
    return rows.withColumns({name: F.col(since) + F.make_dt_interval(F.lit(n)) for name, n in days.items()})
