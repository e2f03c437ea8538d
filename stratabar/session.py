"""Session defaults for this engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "stratabar", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Settings given as a_b=... are not renamed; pass dotted names in a dict."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
