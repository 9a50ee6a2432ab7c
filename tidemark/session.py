"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", **settings: str) -> SparkSession:
    """Adaptive execution on, times in UTC; more settings are given by keyword with _ for a dot."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
