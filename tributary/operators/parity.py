"""Comparison of generated statements with a baseline, and what is measured of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tributary.functions import scan
from tributary.functions import text as T
from tributary.operators import syntax

GATES = ("statement_count_match", "statement_order_match", "target_sequence_match", "projection_policy_match", "clause_shape_match")


def profile(statements: DataFrame) -> DataFrame:
    """(file, n, kinds, targets, policies, shapes): each file's sequences, in statement order."""
    stmt = F.col("stmt")
    row = F.struct(
        "pos", T.statement_kind(stmt).alias("kind"), T.insert_target(stmt).alias("target"), T.star_policy(stmt).alias("policy"), T.shape(stmt).alias("shape")
    )
    ordered = statements.groupBy("file").agg(F.array_sort(F.collect_list(row)).alias("s"))
    pick = lambda name: F.transform("s", lambda x: x[name])
    return ordered.select(
        "file", F.size("s").alias("n"), pick("kind").alias("kinds"), F.array_compact(pick("target")).alias("targets"),
        F.array_compact(pick("policy")).alias("policies"), pick("shape").alias("shapes"),
    )


def compare(baseline: DataFrame, generated: DataFrame) -> DataFrame:
    """(file, baseline_found, five gates, score, all_pass) of every generated file."""
    b = profile(baseline).select("file", *[F.col(c).alias(f"b_{c}") for c in ("n", "kinds", "targets", "policies", "shapes")])
    both = profile(generated).join(b, "file", "left").withColumn("baseline_found", F.col("b_n").isNotNull())
    same = {g: F.coalesce(F.col(c) == F.col(f"b_{c}"), F.lit(False)) for g, c in zip(GATES, ("n", "kinds", "targets", "policies", "shapes"), strict=True)}
    gated = both.select("file", "baseline_found", *[c.alias(g) for g, c in same.items()])
    score = sum((F.col(g).cast("int") for g in GATES), F.lit(0)) / len(GATES)
    every = F.col("baseline_found")
    for g in GATES:
        every = every & F.col(g)
    return gated.withColumn("score", score).withColumn("all_pass", every)


def accept_if_no_worse(before: DataFrame, after: DataFrame, baseline: DataFrame) -> DataFrame:
    """after's statements where its parity score has not fallen, before's elsewhere."""
    scores = compare(baseline, before).select("file", F.col("score").alias("was")).join(compare(baseline, after).select("file", F.col("score").alias("now")), "file", "full")
    better = scores.select("file", (F.coalesce("now", F.lit(0.0)) >= F.coalesce("was", F.lit(0.0))).alias("take"))
    chosen = after.join(better.where("take"), "file", "left_semi").select("file", "pos", "stmt")
    return chosen.unionByName(before.join(better.where("take"), "file", "left_anti").select("file", "pos", "stmt"))


def edges(statements: DataFrame) -> DataFrame:
    """Distinct (file, target, target_col, source_col) of inserts and updates; what a merge assigns is in syntax.column_edges alone."""
    reading = syntax.read(statements).where("read.kind IN ('insert', 'update')")
    return syntax.column_edges(reading).select("file", "target", "target_col", "source_col").distinct()


def edge_text(edge_rows: DataFrame) -> DataFrame:
    """(file, edge) as target.column<-source."""
    return edge_rows.select("file", F.concat("target", F.lit("."), "target_col", F.lit("<-"), "source_col").alias("edge"))


def _rates(tp: str, fp: str, fn: str, empty: float | F.Column) -> tuple:
    p = F.when(F.col(tp) + F.col(fp) > 0, F.col(tp) / (F.col(tp) + F.col(fp))).otherwise(empty)
    r = F.when(F.col(tp) + F.col(fn) > 0, F.col(tp) / (F.col(tp) + F.col(fn))).otherwise(empty)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def edge_scores(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """(case, tp, fp, fn, precision, recall, f1) from distinct (case, edge) tables; cases without expectations count no false positives."""
    e = expected.select("case", F.lower("edge").alias("edge")).distinct().withColumn("want", F.lit(1))
    p = produced.select("case", F.lower("edge").alias("edge")).distinct().withColumn("got", F.lit(1))
    both = e.join(p, ["case", "edge"], "full")
    counts = both.groupBy("case").agg(
        F.count_if(F.col("want").isNotNull() & F.col("got").isNotNull()).alias("tp"),
        F.count_if(F.col("want").isNull()).alias("extra"),
        F.count_if(F.col("got").isNull()).alias("fn"),
        F.count("want").alias("wanted"),
    ).withColumn("fp", F.when(F.col("wanted") > 0, F.col("extra")).otherwise(0))
    p_, r_, f_ = _rates("tp", "fp", "fn", F.when(F.col("wanted") > 0, 0.0).otherwise(1.0))
    return counts.select("case", "tp", "fp", "fn", F.round(p_, 4).alias("precision"), F.round(r_, 4).alias("recall"), F.round(f_, 4).alias("f1"))


def golden_results(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each case's verdict: texts it must and must not contain, edges it must and must not give.

    cases: schemas.CASE; outputs: (case_name, sql). A case without output has the empty text.
    """
    joined = cases.join(outputs, "case_name", "left").withColumn("sql", F.coalesce("sql", F.lit("")))
    low = F.lower("sql")
    none = F.array().cast("array<string>")
    lower = lambda c: F.array_distinct(F.transform(F.coalesce(c, none), F.lower))
    found = F.transform(
        F.flatten(F.transform(scan.split_script_udf("sql"), lambda s: F.array(s))), lambda s: s
    )
    pieces = joined.withColumn("__stmts", found)
    given = edge_text(edges(pieces.select(F.col("case_name").alias("file"), F.posexplode("__stmts").alias("pos", "stmt"))))
    produced = given.groupBy(F.col("file").alias("case_name")).agg(F.collect_set("edge").alias("produced"))
    all_ = pieces.join(produced, "case_name", "left").withColumn("produced", F.coalesce("produced", none)).select(
        "case_name",
        F.filter(F.coalesce("expected_contains", none), lambda x: ~F.contains(low, F.lower(x))).alias("missing"),
        F.filter(F.coalesce("expected_not_contains", none), lambda x: F.contains(low, F.lower(x))).alias("forbidden_found"),
        F.array_except(lower("expected_edges"), F.col("produced")).alias("missing_edges"),
        F.array_intersect(lower("forbidden_edges"), F.col("produced")).alias("forbidden_edges_found"),
        F.size(F.array_intersect(lower("expected_edges"), F.col("produced"))).alias("tp"),
        F.when(F.size(lower("expected_edges")) > 0, F.size(F.array_except("produced", lower("expected_edges")))).otherwise(0).alias("fp"),
        F.size(F.array_except(lower("expected_edges"), F.col("produced"))).alias("fn"),
        (F.size(lower("expected_edges")) > 0).alias("wanted"),
    )
    p, r, f = _rates("tp", "fp", "fn", F.when(F.col("wanted"), 0.0).otherwise(1.0))
    passed = (F.size("missing") == 0) & (F.size("forbidden_found") == 0) & (F.size("missing_edges") == 0) & (F.size("forbidden_edges_found") == 0)
    return all_.select("*", passed.alias("passed"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def golden_summary(results: DataFrame) -> DataFrame:
    """One row: cases, passes, pass rate in percent, micro precision, recall and F1."""
    sums = results.agg(
        F.count("*").alias("total_cases"), F.count_if("passed").alias("passed_cases"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
    )
    p, r, f = _rates("tp", "fp", "fn", F.lit(1.0))
    rate = F.when(F.col("total_cases") > 0, F.round(F.col("passed_cases") / F.col("total_cases") * 100, 2)).otherwise(0.0)
    return sums.select("total_cases", "passed_cases", rate.alias("pass_rate"), F.round(p, 4).alias("micro_precision"), F.round(r, 4).alias("micro_recall"), F.round(f, 4).alias("micro_f1"))


def release_gate(verdicts: DataFrame, summary: DataFrame, min_pass_rate: float = 95.0, min_f1: float = 0.9) -> DataFrame:
    """One row: files, validation pass rate, whether both thresholds hold; no files, no release."""
    v = verdicts.agg(F.count("*").alias("files"), F.count_if("ok").alias("passed"))
    rate = F.when(F.col("files") > 0, F.round(F.col("passed") / F.col("files") * 100, 2)).otherwise(0.0)
    rated = v.select("files", rate.alias("validation_pass_rate"))
    return rated.crossJoin(F.broadcast(summary.select("micro_f1"))).withColumn(
        "released", (F.col("files") > 0) & (F.col("validation_pass_rate") >= min_pass_rate) & (F.col("micro_f1") >= min_f1)
    )  # both sides are one-row aggregates


def _counters() -> list[F.Column]:
    return [
        F.count(F.lit(1)).alias("requests"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(~F.col("valid")).alias("validation_failures"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
    ]


def run_counters(runs: DataFrame, by: str | None = None) -> DataFrame:
    """Requests, successes, failures, validation failures and mean latency of a (ok, valid, latency_ms) log."""
    grouped = runs.groupBy(by) if by else runs.groupBy()
    return grouped.agg(*_counters())


def counted_while(runs: DataFrame, action: Callable[[DataFrame], None]) -> dict[str, int | float | None]:
    """The counters of run_counters, observed while `action` writes the log: no second scan."""
    seen = Observation("counters")
    action(runs.observe(seen, *_counters()))
    return seen.get
