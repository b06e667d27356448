"""Registered queries that read whole scripts: extraction and the full pipeline. Their SQL writes the answers out for each nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import extract
from tributary.plans import pipeline
from tributary.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_SCRIPT = """import requests
TARGET = "mart.{nation}"
STAGE = "stage_" + "{region}"
def load(spark):
    df = spark.sql(f"SELECT a, b AS bb FROM src.{{STAGE}} s JOIN dim.d ON s.a = d.a WHERE s.d = '{{DT}}'")
    df.createOrReplaceTempView("tmp_{key}")
    spark.sql(f"INSERT INTO {{TARGET}} SELECT a, bb FROM tmp_{key}")
def main(spark):
    load(spark)
    hive.executeUpdate("UPDATE mart.{nation} SET a = 1 WHERE k IN (SELECT k FROM src.n{key})")
    spark.read.parquet("s3a://bucket/{region}").write.mode("append").saveAsTable("raw.{nation}")
"""


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, code): a script for each nation, and one that does not parse."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.lit(_SCRIPT.replace("{{", "\1").replace("}}", "\2"))
    for name, value in (("{nation}", F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))), ("{region}", F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))), ("{key}", F.col("n_nationkey").cast("string"))):
        code = F.replace(code, F.lit(name), value)
    code = F.replace(F.replace(code, F.lit("\1"), F.lit("{")), F.lit("\2"), F.lit("}"))
    good = nations.select(F.concat(F.lit("job_"), "n_nationkey").alias("file"), code.alias("code"))
    return good.unionByName(spark.range(1).select(F.lit("broken").alias("file"), F.lit("def f(:\n").alias("code")))


def py_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = extract.operations(extract.extract(scripts(spark, sf_dir)))
    return ops.select("file", "op_no", "op_type", "call_name", "statement_kind", F.array_join("source_assets", ",").alias("sources"), F.array_join("target_assets", ",").alias("targets"), F.array_join("join_predicates", ";").alias("predicates"))


def py_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.variables(extract.extract(scripts(spark, sf_dir)))


def py_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.call_graph(extract.extract(scripts(spark, sf_dir))).withColumn("callees", F.array_join("callees", ","))


def py_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.rejects(extract.extract(scripts(spark, sf_dir)))


def lineage_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(scripts(spark, sf_dir)).statements


def lineage_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(scripts(spark, sf_dir)).verdicts


QUERIES |= {f.__name__: f for f in (py_extract, py_variables, py_call_graph, py_rejects, lineage_pipeline, lineage_verdicts)}

_JOB = """WITH job AS (SELECT 'job_' || CAST(n_nationkey AS VARCHAR) AS file, CAST(n_nationkey AS VARCHAR) AS key, lower(replace(n_name, ' ', '_')) AS nation,
 lower(replace(r_name, ' ', '_')) AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"""

ORACLE_SQL |= {
    "py_extract": f"""{_JOB}
 SELECT file, 1 AS op_no, 'read' AS op_type, 'spark.sql' AS call_name, 'select' AS statement_kind, 'src.' || chr(123) || 'STAGE' || chr(125) || ',dim.d' AS sources, '' AS targets, 's.a = d.a' AS predicates FROM job
 UNION ALL SELECT file, 2, 'write', 'df.createOrReplaceTempView', 'create_temp_view', '', '#tmp_' || key, '' FROM job
 UNION ALL SELECT file, 3, 'write', 'spark.sql', 'insert', 'tmp_' || key, chr(123) || 'TARGET' || chr(125), '' FROM job
 UNION ALL SELECT file, 4, 'write', 'hive.executeUpdate', 'update', 'src.n' || key, 'mart.' || nation, '' FROM job
 UNION ALL SELECT file, 5, 'write', 'spark.read.parquet.write.mode.saveAsTable', '', '', 'raw.' || nation, '' FROM job""",
    "py_variables": f"{_JOB} SELECT file, 0 AS ord, 'TARGET' AS name, 'mart.' || nation AS value FROM job UNION ALL SELECT file, 1, 'STAGE', 'stage_' || region FROM job",
    "py_call_graph": f"{_JOB} SELECT file, 'main' AS fn, 'load' AS callees FROM job",
    "py_rejects": "SELECT 'broken' AS file, 'SyntaxError: invalid syntax (<unknown>, line 1)' AS reason",
    "lineage_pipeline": f"""{_JOB}
 SELECT file, 0 AS pos, 'INSERT INTO #tmp_' || key || ' SELECT a, b AS bb FROM src.stage_' || region || ' s JOIN dim.d ON s.a = d.a;' AS stmt FROM job
 UNION ALL SELECT file, 1, 'INSERT INTO mart.' || nation || ' SELECT a, bb FROM #tmp_' || key || ';' FROM job
 UNION ALL SELECT file, 2, 'INSERT INTO mart.' || nation || chr(10) || 'SELECT tgt.k, tgt.a' || chr(10) || 'FROM mart.' || nation || ' AS tgt' || chr(10) || 'JOIN src.n' || key || ' AS src1 ON 1=1;' FROM job""",
}
