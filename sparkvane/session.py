"""Sessions for tests, benches and stand-alone use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "sparkvane", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides.

    On a cluster leave ``master`` and ``partitions`` out: the submit command and adaptive
    coalescing decide. Expressions in this library never rely on ANSI mode being off.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
