"""Session settings that the library is tuned for; a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and skew handling.

    ``partitions`` sizes shuffles before adaptive coalescing; leave it out on a
    cluster that sets its own.
    """
    builder = SparkSession.builder.appName("quadloom")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("QUADLOOM_DRIVER_MEMORY", "8g"),
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=settings | conf).getOrCreate()
