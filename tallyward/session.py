"""Sessions. On a cluster bring your own; only the settings here matter to results."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Time zone of dates in rules, and adaptive plans.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def prepare(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: str = "*", memory: str = "4g") -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is not None:
        return prepare(found)
    partitions = os.cpu_count() if cores == "*" else int(cores)
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tallyward").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
