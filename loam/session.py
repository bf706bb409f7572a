"""A session with the settings that the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """UTC, AQE with skew handling, Arrow.  On a cluster, submit with the cluster's own master and partitions."""
    spark = (
        SparkSession.builder.master(master)
        .appName("loam")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("WARN")
    return spark
