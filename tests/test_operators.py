"""Set operators, extraction, validation, parity, marts and the pipeline on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from tributary.errors import LimitExceeded
from tributary.operators import extract, marts, parity, quality, resolve, scd
from tributary.operators import statements as S
from tributary.operators import syntax
from tributary.plans import pipeline

SCRIPT = '''
TARGET = "mart.final"
def load(spark):
    df = spark.sql("SELECT a, b AS bb FROM src.raw WHERE d = '{DT}'")
    df.createOrReplaceTempView("tmp")
    spark.sql(f"INSERT INTO {TARGET} SELECT * FROM tmp")
    requests.get("http://x/y")
def main(spark):
    load(spark)
    df.write.mode("append").saveAsTable("raw.t")
'''


@pytest.fixture
def stmts(spark):
    return lambda *rows: spark.createDataFrame([("f", i, s) for i, s in enumerate(rows)], "file string, pos int, stmt string")


def listed(df):
    return [r["stmt"] for r in df.orderBy("pos").collect()]


def test_extraction(spark):
    found = extract.extract(spark.createDataFrame([("ok", SCRIPT), ("bad", "def f(:"), ("none", None)], "file string, code string"))
    ops = extract.operations(found).orderBy("op_no").collect()
    assert [(r.op_type, r.statement_kind, r.source_assets, r.target_assets) for r in ops] == [
        ("read", "select", ["src.raw"], []),
        ("write", "create_temp_view", [], ["#tmp"]),
        ("write", "insert", ["tmp"], ["{TARGET}"]),
        ("read", "", ["http://x/y"], []),
        ("write", "", [], ["raw.t"]),
    ]
    assert [r.name for r in extract.variables(found).collect()] == ["TARGET"]
    assert {(r.fn, tuple(r.callees)) for r in extract.call_graph(found).collect()} == {("main", ("load",))}
    assert [r.file for r in extract.rejects(found).collect()] == ["bad"]


def test_pipeline_gives_explicit_ordered_valid_statements(spark):
    result = pipeline.run(spark.createDataFrame([("ok", SCRIPT)], "file string, code string"))
    got = [r["stmt"] for r in result.statements.orderBy("pos").collect()]
    assert got[0].startswith("INSERT INTO #tmp SELECT a, b") and "WHERE" not in got[0]
    assert got[1] == "INSERT INTO mart.final SELECT a, bb FROM #tmp;"
    answer = pipeline.parse(spark, "x = 1\n")
    assert answer == {"statements": [], "violations": [], "ok": True}
    assert not pipeline.parse(spark, "def f(:")["ok"]


def test_dedupe(stmts):
    twice = stmts("INSERT INTO t SELECT * FROM s;", "insert into  t select * from s;", "INSERT INTO t SELECT a FROM s;", "INSERT INTO #temp_table SELECT a FROM s;", "INSERT INTO #temp_table_1 SELECT a FROM s;")
    assert len(listed(S.dedupe_first(twice))) == 4
    assert listed(S.dedupe_best(twice)) == ["INSERT INTO t SELECT a FROM s;", "INSERT INTO #temp_table SELECT a FROM s;", "INSERT INTO #temp_table_1 SELECT a FROM s;"]


def test_filters_and_twins(stmts):
    assert listed(S.without_noops(stmts("INSERT INTO x SELECT * FROM x;", "INSERT INTO y SELECT * FROM x;"))) == ["INSERT INTO y SELECT * FROM x;"]
    parted = stmts("INSERT INTO t PARTITION (d) SELECT a FROM s;")
    twins = S.partition_twins(parted)
    assert listed(twins) == ["INSERT INTO t PARTITION (d) SELECT a FROM s;", "INSERT INTO t SELECT a FROM s;"]
    assert listed(S.collapse_partitions(twins)) == ["INSERT INTO t SELECT a FROM s;"]
    hop = stmts("INSERT INTO #t SELECT a FROM src;", "INSERT INTO final SELECT a FROM #t;")
    assert listed(S.direct_temp_hops(hop))[1] == "INSERT INTO final SELECT a FROM src;"


def test_chunks_and_overlap(spark):
    code = "\n".join(f"l{i}" for i in range(282))
    units = resolve.line_chunks(spark.createDataFrame([("f", code), ("e", "")], "file string, code string"))
    assert [(r.start_line, r.end_line) for r in units.orderBy("chunk_no").collect()] == [(1, 140), (116, 255), (231, 282)]
    ops = spark.createDataFrame([("f", 1, "op_1", 130, 150), ("f", 2, "op_2", 282, 282)], "file string, op_no int, op_id string, start_line int, end_line int")
    assert [r.op_ids for r in resolve.units_with_ops(units, ops).orderBy("chunk_no").collect()] == [["op_1"], ["op_1"], ["op_2"]]


def test_parity_and_golden(spark, stmts):
    base = stmts("INSERT INTO t SELECT a FROM s;", "UPDATE t SET a = 1;")
    same = parity.compare(base, base).first()
    assert same.score == 1.0 and same.all_pass
    swapped = parity.compare(base, stmts("UPDATE t SET a = 1;", "INSERT INTO t SELECT a FROM s;")).first()
    assert swapped.score < 1 and not swapped.all_pass
    missing = parity.compare(base.where("false"), base).first()
    assert not missing.baseline_found and missing.score == 0
    cases = spark.createDataFrame([("c", "o", ["insert into t"], ["drop"], ["t.a<-a"], None)], "case_name string, output_sql string, expected_contains array<string>, expected_not_contains array<string>, expected_edges array<string>, forbidden_edges array<string>")
    outputs = spark.createDataFrame([("c", "INSERT INTO t SELECT a, b FROM s;")], "case_name string, sql string")
    got = parity.golden_results(cases, outputs)
    assert (got.first().passed, got.first().tp, got.first().fp, got.first().fn) == (True, 1, 1, 0)
    assert parity.golden_summary(got).first().micro_f1 == pytest.approx(0.6667)


def test_marts_scd_quality(spark):
    days = spark.createDataFrame([(0,), (1,), (32,), (3_000_000,), (None,)], "n int").select(marts.serial_to_date(F.col("n")).cast("string").alias("d"))
    assert [r.d for r in days.collect()] == ["1900-01-01", "1900-01-01", "1900-02-01", "2999-12-31", None]
    dim = spark.createDataFrame([(1, "2020-01-01", "2999-12-31"), (1, "2019-01-01", "2019-12-31"), (2, "2020-01-01", "2999-12-31")], "k int, start_date string, end_date string").withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    staged = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    got = scd.close_versions(dim, staged, "k", "2021-05-05")
    assert sorted((r.k, str(r.end_date)) for r in got.collect()) == [(1, "2019-12-31"), (1, "2021-05-04"), (2, "2999-12-31")]
    metric = quality.duplicates_and_nulls(staged, "k").first()
    assert (metric.metric_numeric, metric.is_anomaly, metric.sample_data) == (2, "Yes", "1")
    padded = marts.padded_union([spark.range(1), spark.range(1).withColumn("x", F.lit("q"))], {"id": "bigint", "x": "int"})
    assert [r.x for r in padded.collect()] == [None, None]


def test_partitioned_write_and_files(spark, tmp_path):
    marts.write_partitioned(spark.range(6).withColumn("d", F.col("id") % 2), str(tmp_path / "t"), ["d"])
    assert spark.read.parquet(str(tmp_path / "t")).where("d = 1").count() == 3
    from tributary.sources import files
    from tributary.streaming import statements as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("INSERT INTO t SELECT a FROM s;\nUPDATE t SET a = 1")
    (tmp_path / "in" / "b.py").write_text("x = 1")
    scripts, large = files.read_scripts(spark, str(tmp_path / "in"), max_bytes=3)
    assert scripts.count() == 0 and large.count() == 1
    assert files.read_baselines(spark, str(tmp_path / "in")).first().file == "a"
    query = stream.write(stream.classify(stream.read_statements(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert {r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"insert", "update"}


def test_spellings_and_update_conversion(spark, stmts):
    ops = spark.createDataFrame(
        [("f", 1, "insert", "", ["Src.A"], ["Mart.B"], [("x.CustId", "CustId"), ("count(*)", "count(*)")]),
         ("f", 2, "update", "UPDATE Mart.B SET Flag = 1 WHERE KeyCol IN (SELECT k FROM src.a)", ["src.a", "{V}", "plain"], ["#Tmp"], [])],
        "file string, op_no int, statement_kind string, sql_text string, source_assets array<string>, target_assets array<string>, select_items array<struct<expression:string,alias:string>>",
    )
    variables = spark.createDataFrame([("f", 0, "t", "Lake.C"), ("f", 1, "n", None)], "file string, ord int, name string, value string")
    assets, columns = S.asset_spellings(ops, variables), S.column_spellings(ops)
    assert {tuple(r.names) for r in assets.collect()} == {("#Tmp", "Lake.C", "Mart.B", "Src.A")}
    assert {tuple(r.names) for r in columns.collect()} == {("CustId", "Flag", "KeyCol")}
    got = stmts("INSERT INTO mart.b SELECT custid FROM src.a JOIN LAKE.C;", None)
    cased = S.spelled(S.spelled(got, assets), columns)
    assert {r.stmt for r in cased.collect()} == {"INSERT INTO Mart.B SELECT CustId FROM Src.A JOIN Lake.C;", None}
    known = spark.createDataFrame([], "file string, target string, columns array<string>")
    made = listed(S.updates_as_inserts(stmts("UPDATE t SET a = 1 WHERE k IN (SELECT k FROM s);", "UPDATE t SET a = 1;"), known))
    assert made == ["INSERT INTO t\nSELECT tgt.k, tgt.a\nFROM t AS tgt\nJOIN s AS src1 ON 1=1;", "UPDATE t SET a = 1;"]


def test_valid_writes_fall_back_by_file(spark):
    rows = [("a", 0, "INSERT INTO t SELECT a, FROM s;"), ("a", 1, "INSERT INTO t SELECT a FROM s;"), ("b", 0, "INSERT INTO t SELECT (a FROM s;"), ("b", 1, "INSERT INTO t SELECT a, ;"), ("c", 0, "SELECT 1;")]
    kept = syntax.valid_writes(spark.createDataFrame(rows, "file string, pos int, stmt string"))
    assert {(r.file, r.pos) for r in kept.collect()} == {("a", 1), ("b", 0), ("c", 0)}


def test_insert_by_position_and_limits(spark):
    spark.sql("CREATE TABLE positional (a BIGINT, b STRING) USING parquet")
    try:
        marts.insert_positional(spark.range(2).select("id", F.lit("x").alias("other")), "positional")
        assert sorted(map(tuple, spark.table("positional").collect())) == [(0, "x"), (1, "x")]
        with pytest.raises(ValueError):
            marts.insert_positional(spark.range(1), "positional")
    finally:
        spark.sql("DROP TABLE positional")
    with pytest.raises(LimitExceeded):
        pipeline.parse_batch(spark, {"a": "x = 1"}, pipeline.Config.of_environment({"TRIBUTARY_MAX_FILES": "0", "HOME": "/"}))


def test_words_are_not_gathered_before_they_meet_variables(spark):
    """What a task holds of a statement's words does not grow with its statements; equal statements are filled in alike."""
    held = spark.createDataFrame([("f", 1, "SELECT {DT} FROM DT"), ("f", 1, "SELECT {DT} FROM DT"), ("f", 2, "SELECT x"), ("g", 1, "SELECT DT")], "file string, pos int, stmt string")
    values = spark.createDataFrame([("f", [("DT", "d1")])], "file string, vars array<struct<name:string,value:string>>")
    filled = resolve.with_values(held, values)
    assert sorted(r.stmt for r in filled.collect()) == ["SELECT DT", "SELECT d1 FROM d1", "SELECT d1 FROM d1", "SELECT x"]
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[file#\d+, __row#\d+L?, __word#\d+\]", plan)
