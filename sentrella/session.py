"""Session settings for this engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "sentrella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and Arrow transfer; other settings are the cluster's."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
