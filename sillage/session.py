"""A session with the settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "sillage", **conf: str) -> SparkSession:
    """UTC, adaptive execution and dynamic partition overwrite; ``conf`` names use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
