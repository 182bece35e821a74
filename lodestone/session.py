"""Session factory with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lodestone", **more: str) -> SparkSession:
    """UTC, ANSI, AQE with skew handling; anything set by the cluster (shuffle partitions, memory) is left to it."""
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{k.replace("__", "."): v for k, v in more.items()},
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
