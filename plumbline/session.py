"""The session this library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: str = "8", partitions: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution on, few shuffle partitions."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("plumbline")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
