"""Local Spark session for tests, checks and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rowferry.session import RUNTIME_CONF


def local_session(cpus: str = "8", memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rowferry")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
        # Without it each column expression also records its Python call site.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
