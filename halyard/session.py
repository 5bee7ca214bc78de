"""Session settings that the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans, UTC, and Arrow batches small enough for rows that hold arrays.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(name: str = "halyard", **more: str) -> SparkSession:
    """A session with SETTINGS; more: further settings, dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
