"""The Spark session that examples, tests and the bench use."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Set where the caller doesn't say otherwise; nothing here depends on the size of a cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "tidemark", **conf: object) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k: str(v) for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
