"""Session settings of tests, tools and the bench on one machine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from promptforge.session import get_spark


def local_spark(cpus: str | int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", conf={
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or (8 if cpus == "*" else cpus)),
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": os.environ.get("PF_DRIVER_MEMORY", "16g"),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark
