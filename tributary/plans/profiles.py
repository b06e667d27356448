"""Compliance profiles: ordered chains of statement rewrites, one DataFrame transform each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import scan
from tributary.functions import text as T
from tributary.operators import resolve
from tributary.operators import statements as S
from tributary.operators import syntax
from tributary.staging import staged

PROFILES = ("strict", "baseline_parity", "visual_parity", "baseline_sql_parity")


def profile_of(name: str | None) -> str:
    """A known profile's name; anything else is strict."""
    return name if name in PROFILES else "strict"


def rewrite(statements: DataFrame, *steps) -> DataFrame:
    """Each statement through the column functions in turn, closed by a semicolon at the end.

    One column a step: nested, a step that names its input twice would double it.
    """
    out = statements
    for step in steps:
        out = out.withColumn("stmt", step(F.col("stmt")))
    return out.select("file", "pos", T.terminated(F.col("stmt")).alias("stmt")).where(F.length("stmt") > 1)


def comply(
    statements: DataFrame, contract: DataFrame, known: DataFrame, temps: DataFrame, variables: DataFrame, profile: str = "strict"
) -> DataFrame:
    """Statements rewritten as the profile asks.

    baseline_sql_parity only fills variables in and drops self copies; the others
    repair, project, deduplicate and turn updates into inserts; strict also removes WHERE from inserts,
    baseline_parity adds and collapses partition and temporary-target twins,
    visual_parity strips PARTITION clauses. All drop writes that do not read as whole.
    """
    profile = profile_of(profile)
    filled = resolve.with_values(statements.select("file", "pos", "stmt"), variables)
    clean = S.without_noops(filled)
    if profile == "baseline_sql_parity":
        return syntax.valid_writes(rewrite(clean))
    kept = clean.where(T.is_strict_write(F.col("stmt")))
    fixed = rewrite(kept, T.strip_comments, T.tidy_partition, T.space_partition_by, T.close_subquery, T.collapse_join_wrapper, T.cut_where_on_temp)
    named = S.with_temp_names(fixed, temps)
    whole = S.updates_as_inserts(S.with_known_columns(named, known), known)
    # a staged table, since the twins below read it several times
    unique = staged(S.dedupe_first(S.dedupe_best(whole)), "unique")
    if profile == "strict":
        unique = unique.withColumn("stmt", scan.strip_where_udf("stmt"))
    if profile == "baseline_parity":
        unique = S.collapse_partitions(S.transitive_targets(S.partition_twins(unique), contract))
    if profile == "visual_parity":
        unique = rewrite(unique, T.strip_partition)
    return syntax.valid_writes(unique.withColumn("stmt", scan.uniquify_aliases_udf("stmt")))
