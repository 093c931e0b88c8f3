"""Session factory with the settings every plan in this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tesserae", master: str | None = None, **conf: str) -> SparkSession:
    """UTC timestamps, adaptive execution with skew splitting; callers may override anything."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return b.config(map=base | conf).getOrCreate()
