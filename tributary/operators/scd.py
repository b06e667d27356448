"""Slowly changing dimensions of type 2 as frame rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.marts import OPEN_END, write_partitioned
from tributary.staging import drop_staged, staged


def close_versions(dim: DataFrame, changes: DataFrame, key: str, day: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """dim with the current versions of changed keys ended the day before `day`.

    A changed key may repeat; a null key matches nothing. Versions that are not
    current on `day` stay.
    """
    keys = changes.select(F.col(key).alias("__k")).where("__k IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
    at = F.lit(day).cast("date")
    closes = F.col("__hit").isNotNull() & at.between(F.col(start), F.col(end))
    marked = dim.join(keys, dim[key] == keys["__k"], "left")
    return marked.select(*[F.when(closes, F.date_add(at, -1)).otherwise(dim[c]).alias(c) if c == end else dim[c] for c in dim.columns])


def open_versions(changes: DataFrame, day: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """changes as versions that begin on `day` and have no end yet."""
    return changes.withColumn(start, F.lit(day).cast("date")).withColumn(end, F.lit(OPEN_END).cast("date"))


def apply_scd2(dim: DataFrame, changes: DataFrame, key: str, day: str) -> DataFrame:
    """Closed and opened versions together."""
    return close_versions(dim, changes, key, day).unionByName(open_versions(changes, day))


def current(dim: DataFrame, day: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    return dim.where(F.lit(day).cast("date").between(F.col(start), F.col(end)))


def rewrite_touched(path: str, changes: DataFrame, key: str, day: str, by: list[str], files: int | None = None) -> DataFrame:
    """apply_scd2 on a partitioned Parquet table in place; the partitions that were rewritten.

    Touched are the partitions that hold a current version of a changed key, found by a
    semi-join that reads key, dates and partition alone, and those that new versions go to.
    Only their rows are read, staged, and written back by a dynamic overwrite; files of
    other partitions stay as they are. A null partition value is a partition too. Without
    changes nothing is written.
    """
    spark = changes.sparkSession
    dim = spark.read.parquet(path)
    keys = changes.select(key).where(F.col(key).isNotNull()).distinct()
    closing = current(dim, day).select(key, *by).join(keys, key, "left_semi").select(*by)
    touched = staged(closing.unionByName(changes.select(*by)).distinct(), "touched")
    if touched.isEmpty():
        return touched
    marks = touched.select(*[F.col(c).alias(f"__{c}") for c in by])
    same = [dim[c].eqNullSafe(marks[f"__{c}"]) for c in by]
    rows = staged(apply_scd2(dim.join(marks, same, "left_semi"), changes, key, day).select(*dim.columns), "versions")
    write_partitioned(rows, path, by, mode="overwrite", files=files)
    drop_staged(rows)
    return touched
