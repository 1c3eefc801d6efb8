"""Session with the settings the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "basisline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides. Shuffle partitions are left to the cluster and AQE."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
