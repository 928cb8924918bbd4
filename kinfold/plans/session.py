"""Session settings the engine is written for; a cluster's own settings win where they are already set."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "kinfold", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Return the active session or build one with UTC time, AQE and (locally) few shuffle partitions."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("KINFOLD_DRIVER_MEMORY", "8g"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()
