"""A session with the settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "rillflow", cpus: int | None = None, **conf: str) -> SparkSession:
    cpus = cpus or os.cpu_count() or 1
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
