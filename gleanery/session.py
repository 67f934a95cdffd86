"""A local session with the settings that the tests and the benchmark share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """On a cluster, sessions come from spark-submit; nothing in the library depends on these settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gleanery")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("GLEANERY_DRIVER_MEMORY", "8g"),
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
