"""The Spark session the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "sparrowlog", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew joins; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()
