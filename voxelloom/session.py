"""A Spark session with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that matter for results (time zone) and for plans at any size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "voxelloom", cores: int | str = "*", **settings: str) -> SparkSession:
    """The running session, or a local one; settings win over SETTINGS."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(os.cpu_count() if cores == "*" else cores)} | settings
    spark = SparkSession.builder.appName(name).master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
