"""A session with the settings that results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "timberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; memory and shuffle partitions stay the caller's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
