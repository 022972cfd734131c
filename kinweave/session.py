"""A session with adaptive execution; every setting can be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, name: str = "kinweave", **conf: str) -> SparkSession:
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    return builder.config(map=defaults | conf).getOrCreate()
