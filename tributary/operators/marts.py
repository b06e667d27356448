"""Warehouse building blocks: casts, serial dates, code labels, flags, deduplication, partitioned writes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The calendar bounds of serial day numbers.
OPEN_END = "2999-12-31"
FIRST_DAY = "1900-01-01"
LAST_SERIAL = 2956565


def serial_to_date(serial: Column) -> Column:
    """Day numbers counted from FIRST_DAY as 1: 0 and below is FIRST_DAY, beyond LAST_SERIAL is OPEN_END, null stays."""
    counted = F.date_add(F.lit(FIRST_DAY).cast("date"), F.least(F.greatest(serial, F.lit(1)), F.lit(LAST_SERIAL)).cast("int") - 1)
    return F.when(serial > LAST_SERIAL, F.lit(OPEN_END).cast("date")).when(serial <= 0, F.lit(FIRST_DAY).cast("date")).when(serial.isNotNull(), counted)


def is_month_end(day: Column) -> Column:
    return day == F.last_day(day)


def next_due(day: Column, months: Column, due_day: Column) -> Column:
    """The due day of the month `months` after day, or that month's last day where it is shorter."""
    month = F.add_months(day, months)
    last = F.dayofmonth(F.last_day(month))
    return F.date_add(F.trunc(month, "month"), F.least(due_day, last).cast("int") - 1)


def code_label(code: Column, labels: Mapping[str, str], other: str | None = None) -> Column:
    """A searched CASE over code -> label."""
    out = None
    for k, v in labels.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(other) if out is not None else F.lit(other)


def flag_string(flags: list[Column]) -> Column:
    """One character for each condition: 1 where it holds, 0 where it does not or is null."""
    return F.concat(*[F.when(c, "1").otherwise("0") for c in flags])


def safe_cast(value: Column, kind: str) -> Column:
    """A cast that gives null for text it cannot read."""
    return value.try_cast(kind)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, first by order and then by every column, so that the choice is fixed."""
    total = [*order, *[F.col(c).asc_nulls_last() for c in df.columns]]
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*total))).where("__n = 1").drop("__n")


def padded_union(frames: list[DataFrame], schema: Mapping[str, str]) -> DataFrame:
    """UNION ALL after bringing each frame to the schema: casts, typed nulls for what is missing, that order of columns."""
    shaped = [f.select(*[(F.col(c).try_cast(t) if c in f.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()]) for f in frames]
    out = shaped[0]
    for f in shaped[1:]:
        out = out.unionByName(f)
    return out


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append", files: int | None = None) -> None:
    """A dynamic-partition write. Rows of a partition meet in one task, or are dealt by content over `files` of them, which splits a hot one."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files)) if files else None
    shaped = df.repartition(*by) if spread is None else df.repartition(*by, spread)
    shaped.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def drop_old(df: DataFrame, day: Column, today: Column, keep_days: int) -> DataFrame:
    """Rows of the last keep_days days; 0 keeps everything."""
    return df if keep_days == 0 else df.where(day > F.date_sub(today, keep_days))


def insert_positional(df: DataFrame, name: str, overwrite: bool = False) -> None:
    """INSERT INTO an existing table by position, whatever the columns are called; an overwrite replaces only the partitions it has rows of."""
    width = len(df.sparkSession.table(name).columns)
    if len(df.columns) != width:
        raise ValueError(f"{name} has {width} columns, not {len(df.columns)}")
    df.write.option("partitionOverwriteMode", "dynamic").insertInto(name, overwrite=overwrite)
