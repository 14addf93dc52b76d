"""SparkSession builder."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and maps in which the last of equal keys wins."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(name).config(map=base | conf)
    return (builder.master(master) if master else builder).getOrCreate()
