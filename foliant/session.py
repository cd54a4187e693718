"""Spark session with the settings that the engine's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed join partitions and merges small ones; UTC keeps times comparable.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "foliant", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``; keys in ``conf`` use ``__`` for a dot. The cluster's own settings win unless named here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
