"""The session that queries expect: UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ledgerline", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
