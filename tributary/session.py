"""Session construction and table loading shared by queries, bench and tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the engine is written for (UTC, AQE, ANSI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tributary")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRIBUTARY_DRIVER_MEMORY", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the scan is lazy, so filters and columns push down to it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
