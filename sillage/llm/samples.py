"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(rows: DataFrame, key: str, limit: int, *then: str) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of ``key``; the same rows whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.col(key)), key, *then).limit(limit)
