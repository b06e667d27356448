"""Scripts to statements, violations, edges and verdicts.

The plan is cut at staged tables: what is found in the scripts, their operations, the
statements before and after compliance. Files that fail are tried again, a bounded
number of times; every attempt is a staged table, and `best_of` picks from them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.errors import GenerationFailed, InvalidScripts, LimitExceeded
from tributary.functions import text as T
from tributary.operators import extract, parity, resolve, validate
from tributary.operators import statements as S
from tributary.plans.profiles import comply, profile_of
from tributary.staging import staged


@dataclass(frozen=True)
class Config:
    """Settings of a run."""

    profile: str = "strict"
    chunk_lines: int = 140
    overlap_lines: int = 25
    max_files: int = 50
    max_bytes: int = 1 << 20
    explicit_columns: bool = True
    max_repairs: int = 1
    raise_invalid: bool = False

    @classmethod
    def of(cls, settings: dict[str, str]) -> Config:
        """From text settings such as environment variables; unknown profiles are strict."""
        kinds = {"chunk_lines": int, "overlap_lines": int, "max_files": int, "max_bytes": int, "max_repairs": int, **dict.fromkeys(("explicit_columns", "raise_invalid"), lambda v: v.lower() in ("1", "true", "yes"))}
        given = {k: kinds[k](v) for k, v in settings.items() if k in kinds}
        return cls(profile=profile_of(settings.get("profile")), **given)

    @classmethod
    def of_environment(cls, environment: Mapping[str, str], prefix: str = "TRIBUTARY_") -> Config:
        """From variables such as TRIBUTARY_PROFILE; others are ignored."""
        return cls.of({k[len(prefix) :].lower(): v for k, v in environment.items() if k.startswith(prefix)})


@dataclass(frozen=True)
class Result:
    """Lazy tables of a run."""

    ops: DataFrame
    units: DataFrame
    contract: DataFrame
    statements: DataFrame
    violations: DataFrame
    verdicts: DataFrame
    edges: DataFrame
    rejects: DataFrame


@dataclass(frozen=True)
class Evidence:
    """What the scripts say, as tables that every attempt is made and judged with."""

    ops: DataFrame
    variables: DataFrame
    values: DataFrame
    temps: DataFrame
    contract: DataFrame
    known: DataFrame
    allowed: DataFrame

    @classmethod
    def of(cls, found: DataFrame) -> Evidence:
        variables = extract.variables(found)
        values = resolve.variable_arrays(variables)
        ops = resolve.resolve_variables(extract.operations(found), variables)
        texts = resolve.with_values(ops.select("file", "op_no", "sql_text"), values, "sql_text")
        ops = staged(ops.drop("sql_text").join(texts, ["file", "op_no"]), "operations")
        temps = extract.temp_views(ops)
        contract = staged(S.write_contract(ops, temps), "contract")
        spread = S.propagated_columns(ops, contract, S.known_temp_columns(ops))
        own = S.known_insert_columns(ops)
        known = own.join(spread.select("file", "target"), ["file", "target"], "left_anti").unionByName(spread)
        # known columns are rewritten as one text each, in the spelling that statements get
        texts = known.select("file", F.col("target").alias("pos"), F.array_join("columns", "\x01").alias("stmt"))
        spelled = S.spelled(texts, S.asset_spellings(ops, variables), S.column_spellings(ops))
        known = spelled.select("file", F.col("pos").alias("target"), F.split("stmt", "\x01").alias("columns"))
        return cls(ops, variables, values, temps, contract, staged(known, "columns"), S.allowed_assets(ops, variables, temps))

    def evidenced(self, made: DataFrame) -> DataFrame:
        """A generator's statements (file, pos, stmt): writes only, without names that the scripts do not have."""
        cut = made.withColumn("stmt", T.cut_to_write(T.sanitize(F.col("stmt")))).where(T.is_write_shaped(F.col("stmt")))
        return S.without_hallucinations(cut, self.allowed, self.temps)

    def finished(self, base: DataFrame, config: Config) -> DataFrame:
        """Statements completed by the contract, ordered, spelled as the scripts spell names, and made compliant."""
        placed = S.reordered(S.augmented(base, self.contract), self.contract).select("file", F.col("new_pos").alias("pos"), "stmt")
        spelled = staged(S.spelled(placed, S.asset_spellings(self.ops, self.variables), S.column_spellings(self.ops)), "spelled")
        return staged(comply(spelled, self.contract, self.known, self.temps, self.values, config.profile), "statements")

    def judged(self, statements: DataFrame, config: Config) -> DataFrame:
        return validate.violations(statements, self.ops, self.contract, self.allowed, config.explicit_columns)


def run(
    scripts: DataFrame, config: Config = Config(), generate: Callable[[DataFrame], DataFrame] | None = None, repair: Callable[[DataFrame], DataFrame] | None = None
) -> Result:
    """The whole pipeline over (file, code).

    generate may turn units (with prompts) into further statements (file, pos, stmt);
    without it every statement comes from the operations' own evidence. With a repair,
    files with violations are tried again up to config.max_repairs times: it gets (file,
    script, errors, prompt) and gives statements (file, pos, stmt); where it gives none,
    the contract's own statements are the attempt. A file keeps its best attempt. Without
    one there is nothing new to try: what the contract lacks was added at once. A
    generator that fails raises GenerationFailed; with config.raise_invalid a violation
    that is left raises InvalidScripts.
    """
    found = staged(extract.extract(scripts), "found")  # one parse of the scripts feeds every table below
    evidence = Evidence.of(found)
    ops, contract = evidence.ops, evidence.contract
    units = resolve.prompts(resolve.line_chunks(scripts, config.chunk_lines, config.overlap_lines))
    base = S.evidence_statements(ops).select("file", F.col("op_no").alias("pos"), "stmt")
    if generate is not None:
        try:
            made = generate(units)
        except Exception as reason:
            raise GenerationFailed(str(reason)) from reason
        more = evidence.evidenced(made).select("file", (F.col("pos") + 100_000).cast("int").alias("pos"), "stmt")
        base = base.unionByName(more)
    done = evidence.finished(base, config)
    if repair is not None:
        done, bad = repaired(done, evidence, config, repair)
    else:
        bad = staged(evidence.judged(done, config), "violations")
    if config.raise_invalid and not bad.isEmpty():
        first = bad.orderBy("file", "pos", "rule", "detail").first()
        raise InvalidScripts(f"{first.file}: {first.rule} {first.detail}".strip())
    return Result(ops, resolve.units_with_ops(units, ops), contract, done, bad, validate.verdicts(done, bad), parity.edges(done), extract.rejects(found))


def repaired(done: DataFrame, evidence: Evidence, config: Config, repair: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(statements, violations) after up to config.max_repairs further attempts at the files that have violations."""
    bad = staged(evidence.judged(done, config), "violations")
    attempts = {1: done}
    for attempt in range(2, config.max_repairs + 2):
        if bad.isEmpty():
            break
        failing = bad.select("file").distinct()  # fewer from attempt to attempt
        recovery = S.synthesized(evidence.contract.join(failing, "file", "left_semi")).select("file", F.col("op_no").alias("pos"), "stmt")
        asked = resolve.repair_requests(done.join(failing, "file", "left_semi"), bad)
        given = staged(evidence.evidenced(repair(asked)).select("file", "pos", "stmt").join(failing, "file", "left_semi"), "repairs")
        base = given.unionByName(recovery.join(given.select("file").distinct(), "file", "left_anti"))
        attempts[attempt] = evidence.finished(base, config).join(failing, "file", "left_semi")
        kept = best_of({n: a.join(failing, "file", "left_semi") for n, a in attempts.items()}, evidence.contract, lambda s: evidence.judged(s, config))
        done = staged(done.join(failing, "file", "left_anti").unionByName(kept.select("file", "pos", "stmt")), "statements")
        bad = staged(evidence.judged(done, config), "violations")
    return done, bad


def attempt_scores(statements: DataFrame, contract: DataFrame, bad: DataFrame) -> DataFrame:
    """(file, target_hits, covered, bad): what a file's statements cover of the contract, and how many violations they have."""
    counted = bad.groupBy("file").agg(F.count("*").alias("bad"))
    score = S.contract_score(contract, S.write_coverage(statements))
    return statements.select("file").distinct().join(score, "file", "left").join(counted, "file", "left").na.fill(0, ["target_hits", "covered", "bad"])


def best_of(attempts: Mapping[int, DataFrame], contract: DataFrame, violations_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(file, attempt, pos, stmt): of several attempts (file, pos, stmt) by number, the statements of the one that is kept for each file.

    Attempts are gone through in order. The next one is taken if it is valid and the kept
    one is not, if it covers more (targets written, then contracts covered) without more
    violations, or if it covers the same with fewer. A file without statements in an
    attempt is not in it.
    """
    rows, scores = [], []
    for number, statements in sorted(attempts.items()):
        rows.append(statements.select("file", F.lit(number).alias("attempt"), "pos", "stmt"))
        scores.append(attempt_scores(statements, contract, violations_of(statements)).withColumn("attempt", F.lit(number)))
    tried = reduce(DataFrame.unionByName, scores)
    entry = F.struct("attempt", F.struct("target_hits", "covered").alias("score"), "bad")
    listed = tried.groupBy("file").agg(F.array_sort(F.collect_list(entry)).alias("tries"))

    def taken(kept: Column, new: Column) -> Column:
        valid = (new["bad"] == 0) & (kept["bad"] > 0)
        more = (new["score"] > kept["score"]) & (new["bad"] <= kept["bad"])
        cleaner = (new["score"] == kept["score"]) & (new["bad"] < kept["bad"])
        return F.when(valid | more | cleaner, new).otherwise(kept)

    best = listed.select("file", F.aggregate("tries", F.col("tries")[0], taken)["attempt"].alias("attempt"))
    return reduce(DataFrame.unionByName, rows).join(best, ["file", "attempt"], "left_semi")


def parse(spark: SparkSession, code: str, name: str = "script", config: Config = Config()) -> dict:
    """One script, answered as a dictionary: its statements in order, whether they are valid, and why not."""
    return parse_batch(spark, {name: code}, config)[name]


def parse_batch(spark: SparkSession, codes: dict[str, str], config: Config = Config()) -> dict[str, dict]:
    """Several scripts at once; a bounded interactive call (max_files scripts of max_bytes), so its answer is collected."""
    if len(codes) > config.max_files:
        raise LimitExceeded(f"more than {config.max_files} files")
    large = [n for n, c in codes.items() if len(c.encode("utf-8")) > config.max_bytes]
    if large:
        raise LimitExceeded(f"larger than {config.max_bytes} bytes: {', '.join(large)}")
    result = run(spark.createDataFrame(list(codes.items()), "file string, code string"), config)
    out: dict[str, dict] = {n: {"statements": [], "violations": [], "ok": True} for n in codes}
    for r in result.statements.orderBy("file", "pos").collect():
        out[r["file"]]["statements"].append(r["stmt"])
    for r in result.violations.collect():
        out[r["file"]]["violations"].append(f"{r['rule']} {r['detail']}".strip())
    for r in result.rejects.collect():
        out[r["file"]]["violations"].append(r["reason"])
    return {n: v | {"ok": not v["violations"]} for n, v in out.items()}
