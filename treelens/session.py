"""Session builder with the settings every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "4g", **more: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter sets the same keys."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | more
    builder = SparkSession.builder.master(f"local[{cores}]").appName("treelens")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
