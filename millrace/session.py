"""Session settings that the library assumes: UTC, adaptive execution, Arrow, generated methods that the JVM compiles."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "millrace", **conf: str) -> SparkSession:
    """A session; on a cluster leave master and memory to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.codegen.hugeMethodLimit": "8000",  # longer methods would be interpreted; without them Spark splits
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
