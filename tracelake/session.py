"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **extra: str) -> SparkSession:
    """A session with UTC times, ANSI semantics and adaptive execution; keys of extra use _ for dots."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    conf |= {k.replace("_", "."): v for k, v in extra.items()}
    return SparkSession.builder.master(master).appName("tracelake").config(map=conf).getOrCreate()
