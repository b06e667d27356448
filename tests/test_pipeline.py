"""The pipeline: small plans, repairs that win and lose, names, golden cases end to end."""

import json

import pytest
from pyspark.sql import functions as F

from tributary.errors import GenerationFailed, InvalidScripts
from tributary.operators import parity, resolve
from tributary.operators import statements as S
from tributary.plans import pipeline, script_queries
from tributary.sources import files

SCRIPT = """TARGET = "Mart.T"
def main(spark):
    spark.sql(f"INSERT INTO {TARGET} SELECT CustId, Flag FROM Src.A")
    spark.sql("INSERT INTO mart.u SELECT custid FROM SRC.a WHERE x = 1")
"""
#: A write whose text is cut off: no evidence that reads as whole, so one violation.
CUT = 'spark.sql("INSERT INTO mart.cut SELECT * FROM src.a")\n'


def run(spark, scripts, **more):
    return pipeline.run(spark.createDataFrame(list(scripts.items()), "file string, code string"), **more)


def listed(frame):
    return sorted((r.file, r.stmt) for r in frame.collect())


def test_plans_stay_small(spark, sf):
    result = pipeline.run(script_queries.scripts(spark, sf))
    lines = {name: len(getattr(result, name)._jdf.queryExecution().analyzed().toString().splitlines()) for name in ("ops", "statements", "violations", "verdicts", "edges")}
    assert max(lines.values()) < 200, lines


def test_names_are_spelled_as_first_seen(spark):
    result = run(spark, {"f": SCRIPT})
    assert listed(result.statements) == [("f", "INSERT INTO Mart.T SELECT CustId, Flag FROM Src.A;"), ("f", "INSERT INTO mart.u SELECT CustId FROM Src.A;")]


def answers(spark, rows):
    return lambda asked: asked.join(spark.createDataFrame(rows, "file string, pos int, stmt string"), "file").select("file", "pos", "stmt")


def test_a_second_attempt_wins(spark):
    first = run(spark, {"good": SCRIPT, "cut": CUT})
    assert {r.rule for r in first.violations.collect()} == {"select_star"}
    better = run(spark, {"good": SCRIPT, "cut": CUT}, repair=answers(spark, [("cut", 0, "INSERT INTO mart.cut SELECT a, b FROM src.a;"), ("good", 0, "INSERT INTO Mart.T SELECT oops FROM Src.A;")]))
    assert ("cut", "INSERT INTO mart.cut SELECT a, b FROM src.a;") in listed(better.statements) and better.violations.count() == 0
    assert listed(better.statements.where("file = 'good'")) == listed(first.statements.where("file = 'good'"))


def test_a_second_attempt_loses(spark):
    first = run(spark, {"cut": CUT})
    for rows in ([("cut", 0, "INSERT INTO mart.cut SELECT * FROM nowhere.x;")], [("cut", 0, "nothing")], []):
        worse = run(spark, {"cut": CUT}, repair=answers(spark, rows), config=pipeline.Config(max_repairs=2))
        assert listed(worse.statements) == listed(first.statements) and worse.violations.count() == first.violations.count()


def test_requests(spark):
    statements = spark.createDataFrame([("a", 1, "y;"), ("a", 0, "x;")], "file string, pos int, stmt string")
    bad = spark.createDataFrame([("a", 1, "select_star", ""), ("b", None, "no_statements", "")], "file string, pos int, rule string, detail string")
    got = {r.file: r for r in resolve.repair_requests(statements, bad).collect()}
    assert got["a"].script == "x;\ny;" and got["a"].errors == ["1 select_star"] and got["b"].script == "" and "- file no_statements" in got["b"].prompt
    assert resolve.refine_requests(statements).first().prompt.endswith("x;\ny;")


@pytest.mark.parametrize(
    ("tries", "kept"),
    [  # (target hits, covered, violations) of each attempt
        ([(1, 1, 0), (2, 2, 0)], 2), ([(1, 1, 0), (2, 2, 1)], 1), ([(1, 1, 2), (0, 0, 0)], 2), ([(1, 1, 2), (1, 1, 1)], 2), ([(1, 1, 1), (1, 1, 1)], 1),
        ([(1, 1, 3), (2, 0, 3), (2, 1, 4)], 2), ([(1, 1, 1), (0, 0, 0), (1, 1, 0)], 3),
    ],
)
def test_which_attempt_is_kept(spark, monkeypatch, tries, kept):
    row = lambda k: spark.createDataFrame([("f", k, f"s{k}")], "file string, pos int, stmt string")
    score = lambda s, contract, bad: s.select("file", *[F.element_at(F.lit([t[i] for t in tries]), F.col("pos")).alias(n) for i, n in enumerate(("target_hits", "covered", "bad"))])
    monkeypatch.setattr(pipeline, "attempt_scores", score)
    got = pipeline.best_of({k: row(k) for k in range(1, len(tries) + 1)}, None, lambda s: None).collect()
    assert [(r.attempt, r.stmt) for r in got] == [(kept, f"s{kept}")]


def test_renaming_looks_only_at_names(spark):
    rows = spark.createDataFrame([("f", 0, """INSERT INTO mart.b SELECT q.custid, 'mart.b custid', x AS "mart.b" FROM Mart.B, {custid} -- it"""), ("f", 1, None), ("g", 0, "custid")], "file string, pos int, stmt string")
    names = spark.createDataFrame([("f", ["Mart.B", "CustId", *[f"Other{i}" for i in range(3000)]])], "file string, names array<string>")
    got = {(r.file, r.pos): r.stmt for r in S.spelled(rows, names).collect()}
    assert got == {("f", 0): """INSERT INTO Mart.B SELECT q.CustId, 'mart.b custid', x AS "Mart.B" FROM Mart.B, {custid} -- it""", ("f", 1): None, ("g", 0): "custid"}
    temps = spark.createDataFrame([("f", "#tmp")], "file string, asset string")
    got = S.with_temp_names(spark.createDataFrame([("f", 0, 'SELECT TMP.a FROM tmp, #tmp, db.tmp, "/x/tmp"')], "file string, pos int, stmt string"), temps)
    assert got.first().stmt == 'SELECT #tmp.a FROM #tmp, #tmp, db.tmp, "/x/tmp"'


def test_values_fill_values(spark):
    values = spark.createDataFrame([("f", [("A", "x_{B}"), ("B", "1"), ("UNUSED", "u")])], "file string, vars array<struct<name:string,value:string>>")
    rows = spark.createDataFrame([("f", 0, "INSERT INTO {A} SELECT B, '{C}' FROM s_{B}"), ("f", 1, None), ("g", 0, "{A}")], "file string, pos int, stmt string")
    got = {(r.file, r.pos): r.stmt for r in resolve.with_values(rows, values).collect()}
    assert got == {("f", 0): "INSERT INTO x_1 SELECT 1, '{C}' FROM s_1", ("f", 1): None, ("g", 0): "{A}"}


def test_golden_cases_end_to_end(spark, tmp_path):
    """Cases in files, scripts through the pipeline, edges and texts of what comes out, and the gate."""
    cases = {
        "plain": ({"f": SCRIPT}, {"expected_contains": ["insert into mart.t"], "expected_not_contains": ["hive_metastore.db.table"], "expected_edges": ["mart.t.custid<-custid", "mart.t.flag<-flag", "mart.u.custid<-custid"]}),
        "temp": ({"f": 'df = spark.sql("SELECT a, b AS c FROM src.x")\ndf.createOrReplaceTempView("tmp")\nspark.sql("INSERT INTO mart.y SELECT a, c FROM tmp")\n'}, {"expected_contains": ["INSERT INTO #tmp", "INSERT INTO mart.y"], "expected_not_contains": ["ON 1=1"], "expected_edges": ["#tmp.a<-a", "#tmp.c<-b", "mart.y.a<-a", "mart.y.c<-c"]}),
        "update": ({"f": 'hive.executeUpdate("UPDATE mart.s SET end_date = 1 WHERE k IN (SELECT k FROM stage.s)")\n'}, {"expected_contains": ["stage.s"], "expected_not_contains": ["update "], "forbidden_edges": ["mart.s.k<-<derived>"]}),
        "wrong": ({"f": CUT}, {"expected_contains": ["no such text"], "expected_not_contains": []}),
    }
    made = []
    for name, (scripts, case) in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"python_file": f"{name}.py", "output_sql": f"{name}.sql", **case}))
        made.append((name, scripts["f"]))
    result = pipeline.run(spark.createDataFrame(made, "file string, code string"))
    outputs = S.scripts_of(result.statements).select(F.col("file").alias("case_name"), F.col("script").alias("sql"))
    results = parity.golden_results(files.read_golden_cases(spark, str(tmp_path)), outputs)
    assert {r.case_name: r.passed for r in results.collect()} == {"plain": True, "temp": True, "update": True, "wrong": False}
    summary = parity.golden_summary(results)
    assert (summary.first().pass_rate, summary.first().micro_f1) == (75.0, 1.0)
    assert parity.release_gate(result.verdicts, summary).first() is not None


def test_typed_errors(spark):
    def broken(units):
        raise OSError("no answer")

    with pytest.raises(GenerationFailed, match="no answer"):
        run(spark, {"f": SCRIPT}, generate=broken)
    with pytest.raises(InvalidScripts, match="cut: select_star"):
        run(spark, {"cut": CUT}, config=pipeline.Config(raise_invalid=True))
