"""Sources and sinks: scripts, baselines, golden cases, generated SQL, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import schemas

MAX_BYTES = 1 << 20


def stem(path: F.Column) -> F.Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_scripts(spark: SparkSession, folder: str, pattern: str = "*.py", max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(file, code) of matching files directly in folder, and (file, reason) of those over max_bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = found.withColumn("file", stem(F.col("path")))
    fine = named.where(F.col("length") <= max_bytes).select("file", F.col("content").cast("string").alias("code"))
    return fine, named.where(F.col("length") > max_bytes).select("file", F.concat(F.lit("larger than "), F.lit(max_bytes), F.lit(" bytes")).alias("reason"))


def read_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, script) of the .sql files of a folder."""
    found = spark.read.option("wholetext", True).option("pathGlobFilter", "*.sql").text(folder)
    return found.select(stem(F.input_file_name()).alias("file"), F.col("value").alias("script"))


def read_golden_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Golden cases (schemas.CASE) of the .json files of a folder."""
    fields = schemas.CASE.replace("case_name string, ", "")
    rows = spark.read.schema(fields).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.select(stem(F.input_file_name()).alias("case_name"), "*")


def read_any(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """A generic reader: parquet, orc, csv, json, text, jdbc and what else the session knows."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path) if kind != "jdbc" else reader.load()


def write_any(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", **options: str) -> None:
    df.write.format(kind).mode(mode).options(**options).save(path)


def write_scripts(scripts: DataFrame, path: str, dry_run: bool = False) -> None:
    """(file, script) as text, one folder a file; a dry run writes nothing."""
    if not dry_run:
        scripts.select("file", F.col("script").alias("value")).repartition("file").write.mode("overwrite").partitionBy("file").text(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON object a line, stamped with the time of writing (UTC)."""
    reports.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).write.mode("overwrite").json(path)
