"""Synthetic statements and operations from the customer table, as expressions that Spark SQL and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import table

_K = "CAST(CAST(floor(c_custkey / 8) AS BIGINT) % 5 AS STRING)"
_N = "CAST(c_nationkey AS STRING)"
_SRC = f"'src.n' || {_N}"
_MART = f"'mart.r' || {_K}"

FILE = "'f' || CAST(c_custkey % 37 AS STRING)"
POS = "CAST(c_custkey AS INT)"
STMT = f"""CASE CAST(c_custkey % 8 AS INT)
 WHEN 0 THEN 'INSERT INTO ' || {_MART} || ' SELECT * FROM ' || {_SRC} || ';'
 WHEN 1 THEN 'INSERT INTO ' || {_MART} || ' SELECT a, b AS bb FROM ' || {_SRC} || ' WHERE d = ''' || chr(123) || 'DT' || chr(125) || ''' GROUP BY a;'
 WHEN 2 THEN 'INSERT INTO #tmp_r' || {_K} || ' PARTITION (d) SELECT a FROM ' || {_SRC} || ' JOIN dim.r' || {_K} || ' ON a = b;'
 WHEN 3 THEN 'UPDATE ' || {_MART} || ' SET a = 1 WHERE k IN (SELECT k FROM ' || {_SRC} || ');'
 WHEN 4 THEN 'MERGE INTO ' || {_MART} || ' USING ' || {_SRC} || ' ON k = k WHEN MATCHED THEN UPDATE SET a = 1;'
 WHEN 5 THEN 'insert into  MART.R' || {_K} || ' select *   from SRC.N' || {_N} || ' ;'
 WHEN 6 THEN 'INSERT INTO ' || {_MART} || ' SELECT * FROM ' || {_MART} || ';'
 ELSE 'INSERT INTO ' || {_MART} || ' PARTITION (d) SELECT a FROM hive_metastore.db.table; -- checked' END"""
OP_TYPE = "CASE WHEN c_custkey % 8 IN (5, 6, 7) THEN 'read' ELSE 'write' END"
OP_KIND = "CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN 'insert' WHEN 1 THEN 'insert' WHEN 2 THEN 'create_temp_view' WHEN 3 THEN 'update' WHEN 4 THEN 'merge' ELSE 'select' END"
OP_TARGET = f"CASE WHEN c_custkey % 8 = 2 THEN '#tmp_r' || {_K} WHEN c_custkey % 8 IN (0, 1, 3, 4) THEN {_MART} END"
OP_SOURCE = f"CASE WHEN c_custkey % 8 <> 2 THEN {_SRC} END"
OP_SQL = f"CASE WHEN c_custkey % 8 IN (0, 1, 3, 4) THEN {STMT} WHEN c_custkey % 8 = 2 THEN '' ELSE 'SELECT a FROM ' || {_SRC} END"

#: CTEs for the oracle queries.
STATEMENTS_CTE = f"statements AS (SELECT {FILE} AS file, {POS} AS pos, {STMT} AS stmt FROM customer)"
OPS_CTE = (
    f"ops AS (SELECT {FILE} AS file, {POS} AS op_no, {OP_TYPE} AS op_type, {OP_KIND} AS kind, {OP_TARGET} AS target, {OP_SOURCE} AS source, {OP_SQL} AS sql_text FROM customer)"
)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, pos, stmt)."""
    return table(spark, sf_dir, "customer").selectExpr(f"{FILE} AS file", f"{POS} AS pos", f"{STMT} AS stmt")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op rows as the extraction gives them."""
    raw = table(spark, sf_dir, "customer").selectExpr(
        f"{FILE} AS file", f"{POS} AS op_no", f"{OP_TYPE} AS op_type", f"{OP_KIND} AS statement_kind", f"{OP_TARGET} AS target", f"{OP_SOURCE} AS source", f"{OP_SQL} AS sql_text"
    )
    none = F.array().cast("array<string>")
    item = F.array(F.struct(F.lit("a").alias("expression"), F.lit("a").alias("alias")))
    return raw.select(
        "file", "op_no", F.concat(F.lit("op_"), "op_no").alias("op_id"), "op_type", "statement_kind", "sql_text",
        F.when(F.col("source").isNull(), none).otherwise(F.array("source")).alias("source_assets"),
        F.when(F.col("target").isNull(), none).otherwise(F.array("target")).alias("target_assets"),
        F.when(F.col("op_type") == "read", item).otherwise(F.array().cast(item_type())).alias("select_items"),
    )


def item_type() -> str:
    return "array<struct<expression:string,alias:string>>"


def temps(ops: DataFrame) -> DataFrame:
    made = ops.where("statement_kind = 'create_temp_view'")
    return made.select("file", F.lower(F.col("target_assets")[0]).alias("asset")).distinct()
