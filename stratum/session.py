"""The session that the library is tested with; any other works too."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "stratum", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow; conf goes on top, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
