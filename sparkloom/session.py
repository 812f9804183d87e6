"""The Spark session that the engine expects: UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("sparkloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
