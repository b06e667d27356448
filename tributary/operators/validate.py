"""Validation rules: each rule is a filter over statements; violations are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import text as T

VIOLATION = "file string, pos int, rule string, detail string"


def statement_violations(statements: DataFrame, explicit_columns: bool = True) -> DataFrame:
    """(file, pos, rule, detail) of single statements, all rules in one pass."""
    stmt = F.col("stmt")
    kind = T.strict_kind(stmt)
    star = rf"(?is)^\s*INSERT\s+INTO\s+{T.ASSET}(?:\s+PARTITION\s*\([^)]+\))?\s+SELECT\s+\*\s+FROM\b"
    rules = {
        "not_a_write": kind.isNull(),
        "insert_without_from": (kind == "insert") & ~stmt.rlike(r"(?i)\bFROM\b"),
        "update_without_set": (kind == "update") & ~stmt.rlike(r"(?i)\bSET\b"),
        "merge_without_using": (kind == "merge") & ~stmt.rlike(r"(?i)\bUSING\b"),
        "not_terminated": ~F.rtrim(stmt).endswith(";"),
    }
    if explicit_columns:
        rules["select_star"] = stmt.rlike(star)
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())
    return statements.select("file", "pos", F.explode(broken).alias("rule"), F.lit("").alias("detail"))


def missing_targets(statements: DataFrame, contract: DataFrame) -> DataFrame:
    """Targets that the operations write and no statement of the file names."""
    named = statements.select("file", F.explode(F.concat(T.target_assets(F.col("stmt")), T.source_assets(F.col("stmt")))).alias("a"))
    have = named.select("file", T.match_key(F.col("a")).alias("__key")).distinct()
    need = contract.select("file", "target", T.match_key(F.col("target")).alias("__key")).distinct()
    return need.join(have, ["file", "__key"], "left_anti").select(
        "file", F.lit(None).cast("int").alias("pos"), F.lit("missing_target").alias("rule"), F.col("target").alias("detail")
    )


def unknown_sources(statements: DataFrame, allowed: DataFrame) -> DataFrame:
    """Sources that no operation of the file evidences; files without any evidence are not judged."""
    used = statements.select("file", F.explode(T.evidence_sources(F.col("stmt"))).alias("source"))
    keyed = used.select("file", "source", T.match_key(F.col("source")).alias("key")).distinct()
    judged = allowed.select("file").distinct()
    return keyed.join(allowed, ["file", "key"], "left_anti").join(judged, "file", "left_semi").select(
        "file", F.lit(None).cast("int").alias("pos"), F.lit("unknown_source").alias("rule"), F.col("source").alias("detail")
    )


def empty_files(statements: DataFrame, ops: DataFrame) -> DataFrame:
    """Files with operations and no statement."""
    bare = ops.select("file").distinct().join(statements.select("file").distinct(), "file", "left_anti")
    return bare.select("file", F.lit(None).cast("int").alias("pos"), F.lit("no_statements").alias("rule"), F.lit("").alias("detail"))


def violations(statements: DataFrame, ops: DataFrame, contract: DataFrame, allowed: DataFrame, explicit_columns: bool = True) -> DataFrame:
    """All rules together."""
    return (
        statement_violations(statements, explicit_columns)
        .unionByName(missing_targets(statements, contract))
        .unionByName(unknown_sources(statements, allowed))
        .unionByName(empty_files(statements, ops))
    )


def verdicts(statements: DataFrame, found: DataFrame) -> DataFrame:
    """(file, statement_count, violations, ok)."""
    counts = statements.groupBy("file").agg(F.count("*").alias("statement_count"))
    bad = found.groupBy("file").agg(F.count("*").alias("violations"))
    return counts.join(bad, "file", "full").select(
        "file", F.coalesce("statement_count", F.lit(0)).alias("statement_count"), F.coalesce("violations", F.lit(0)).alias("violations"),
        F.col("violations").isNull().alias("ok"),
    )
