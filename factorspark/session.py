"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "factorspark", **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution; ``conf`` overrides, with underscores for dots."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (defaults | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
