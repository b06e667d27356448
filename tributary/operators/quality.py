"""Quality metrics: rows of (metric_flag, metric_numeric, sample_data, is_anomaly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(flag: str, value: Column, anomaly: Column, sample: Column | None = None) -> list[Column]:
    return [
        F.lit(flag).alias("metric_flag"), value.cast("long").alias("metric_numeric"),
        (F.lit(None).cast("string") if sample is None else sample.cast("string")).alias("sample_data"),
        F.when(anomaly, "Yes").otherwise("No").alias("is_anomaly"),
    ]


def row_count_band(df: DataFrame, now: Column, before: Column, band: float, flag: str = "row_count") -> DataFrame:
    """Rows where `now` holds against rows where `before` does, in one scan: outside the band is an anomaly."""
    c = df.agg(F.count_if(now).alias("a"), F.count_if(before).alias("b"))
    out = (F.col("a") < F.col("b") * (1 - band)) | (F.col("a") > F.col("b") * (1 + band))
    return c.select(*_row(flag, F.col("a"), out))


def duplicates_and_nulls(df: DataFrame, key: str, flag: str = "duplicates") -> DataFrame:
    """Keys that occur more than once, plus null keys."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    c = per.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise((F.col("n") > 1).cast("long"))), F.lit(0)).alias("v"),
        F.min(F.when((F.col("n") > 1) & F.col(key).isNotNull(), F.col(key))).alias("s"),
    )
    return c.select(*_row(flag, F.col("v"), F.col("v") > 0, F.col("s")))


def table_match(left: DataFrame, right: DataFrame, flag: str = "table_match") -> DataFrame:
    """The row counts of two tables must be equal; both sides are one-row aggregates."""
    a, b = left.agg(F.count("*").alias("a")), right.agg(F.count("*").alias("b"))
    return a.crossJoin(F.broadcast(b)).select(*_row(flag, F.col("a"), F.col("a") != F.col("b")))
