"""Session with the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "quillmere", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's own settings apply."""
    n = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
