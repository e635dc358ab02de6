"""Session settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "saltmarsh", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides any setting (dots written as in Spark)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | conf
    builder = SparkSession.builder.appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
