"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "cuesheet", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution. Partition counts are left to it and to the cluster's settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in (base | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
