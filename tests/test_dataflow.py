"""Following scripts: chains, calls, loops, sinks."""

import ast

from pyspark.sql import functions as F

from tributary.functions import flow
from tributary.operators import dataflow


def rows(code):
    return [dict(zip(flow.STEP, r, strict=True)) for r in flow.follow(code)]


def made(spark, *codes):
    return dataflow.follow(spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(codes)], "file string, code string"))


def stmts(spark, *codes):
    return [r.stmt for r in dataflow.statements(made(spark, *codes)).orderBy("file", "pos").collect()]


def test_a_write_inside_a_function_called_twice(spark):
    code = "def load(t, src):\n    spark.table(src).write.saveAsTable(t)\nload('a', 'x')\nload(src='y', t='b')\n"
    assert stmts(spark, code) == ["INSERT INTO a SELECT * FROM x;", "INSERT INTO b SELECT * FROM y;"]


def test_recursion_ends_in_a_reject():
    found = rows("def f(n):\n    g(n)\ndef g(n):\n    f(n)\n    spark.sql('INSERT INTO t SELECT a FROM ' + n)\nf('s')\n")
    assert [(r["name"], r["sql"], r["line"]) for r in found if r["what"] == "reject"] == [("recursion", "f>g>f", 4)]
    assert [r["sql"] for r in found if r["what"] == "sql"] == ["INSERT INTO t SELECT a FROM s"]


def test_defaults_globals_and_returns():
    code = "SRC = 'g'\ndef read(name=SRC, *, more='m'):\n    if name:\n        return spark.table(name)\n    return None\nread().write.saveAsTable('t')\n"
    write = rows(code)[-1]
    assert (write["name"], write["cte"]) == ("t", "g")


def test_thirty_one_iterations_are_expanded_and_thirty_two_are_not():
    code = "for i in range({n}):\n    spark.sql(f'INSERT INTO t{{i}} SELECT a FROM s')\n"
    full, over = rows(code.format(n=31)), rows(code.format(n=32))
    assert [r["sql"][12:15].strip() for r in full] == [f"t{i}" for i in range(31)] and full[3]["loop"] == "i=3"
    assert [(r["what"], r["name"], r["sql"]) for r in over] == [("reject", "loop_bound", "i: 32 iterations"), ("sql", "", "INSERT INTO t{i} SELECT a FROM s")]


def test_nested_loops_comprehensions_and_unknown_ones():
    code = "[spark.sql(f'INSERT INTO {a}_{b} SELECT 1 FROM s') for a in ['x', 'y']]\n"
    assert rows(code)[0]["sql"] == "INSERT INTO x_{b} SELECT 1 FROM s"
    found = rows("for a in ['x', 'y']:\n    for i, b in enumerate([1, 2]):\n        spark.sql(f'INSERT INTO {a}_{b}_{i} SELECT 1 FROM s')\nwhile True:\n    spark.table(t).write.saveAsTable(u)\n")
    assert [r["sql"][12:17] for r in found if r["what"] == "sql"] == ["x_1_0", "x_2_1", "y_1_0", "y_2_1"]
    assert [r["name"] for r in found if r["what"] == "reject"] == ["loop_unknown"]


def test_too_many_steps(monkeypatch):
    monkeypatch.setattr(flow, "MAX_STEPS", 50)
    code = "for a in range(31):\n    for b in range(31):\n        spark.table('x').write.saveAsTable(f't{a}_{b}')\n"
    found = rows(code)
    assert len(found) == 51 and found[-1]["name"] == "too_many_steps"


def test_a_long_chain(spark):
    chain = "df = spark.table('s').select('a', 'b')\n" + "".join(f"df = df.withColumn('c{i}', F.col('a') + {i})\n" for i in range(200)) + "df.select('c199').write.saveAsTable('t')\n"
    (stmt,) = stmts(spark, chain)
    assert stmt.startswith("WITH df AS (SELECT a, b FROM s), df_2 AS (SELECT a, b, a + 0 AS c0 FROM df), ") and stmt.endswith("INSERT INTO t SELECT c199 FROM step_202;")


def test_expressions():
    code = """from pyspark.sql import functions as F
a = spark.table('s')
b = a.filter((a.x == 'it''s') & ~F.col('y').isin([1, 2]) | F.col('z').isNull()).agg({'v': 'max'})
c = a.select(F.col('x').cast('int').alias('n'), F.coalesce(F.col('y'), F.lit(0)), -F.col('z'), F.expr('p + q AS r'))
d = a.join(c, ['k', 'l'], 'left_anti').orderBy(F.col('k').desc()).limit(3)
e = a.alias('q').crossJoin(c)
f = a.union(c).withColumnRenamed('p', 'q')
"""
    assert [r["sql"] for r in rows(code) if r["what"] == "frame"][1:] == [
        "SELECT * FROM s WHERE ((x = 'its') AND (NOT (y IN (1, 2)))) OR (z IS NULL)",
        "SELECT max(v) AS max_v FROM step_1",
        "SELECT CAST(x AS int) AS n, coalesce(y, 0), -z, p + q AS r FROM s",
        "SELECT * FROM s LEFT ANTI JOIN c USING (k, l)",
        "SELECT * FROM step_4 ORDER BY k DESC",
        "SELECT * FROM step_5 LIMIT 3",
        "SELECT * FROM s AS l CROSS JOIN c AS r",
        "SELECT * FROM s UNION ALL SELECT n, coalesce(y, 0), -z, p + q AS r FROM c",
        "SELECT *, p AS q FROM step_9",
    ]


def test_odd_scripts(spark):
    flows = made(spark, None, "", "def f(:", "x = 1\n" * 5000, "é = 'ü'\nspark.table(é).write.saveAsTable('ß')")
    assert [(r.file, r.reason) for r in dataflow.rejects(flows).collect()] == [("f2", "syntax")]
    assert [r.stmt for r in dataflow.statements(flows).collect()] == ["INSERT INTO ß SELECT * FROM ü;"]
    none = flows.where("false")
    assert dataflow.statements(none).count() == dataflow.assets(none).count() == dataflow.other_calls(none).count() == 0


def test_sinks_without_what_they_need(spark):
    code = "d = spark.table('s')\nd.write.format('kafka').save()\nd.write.format('neo4j').option('labels', '::A: B :').save()\nd.write.format('odd').save('p.q')\n"
    got = {tuple(r) for r in dataflow.assets(made(spark, code)).where("access = 'write'").select("kind", "asset").collect()}
    assert got == {("topic", ""), ("label", "A"), ("label", "B"), ("path", "p.q")}


def test_scripts_are_dealt_and_followed_once(spark):
    """One input partition does not make one task of all scripts, and what is read of flows does not follow them again."""
    one = spark.createDataFrame([(f"f{i}", f"spark.table('t{i}').write.saveAsTable('u{i}')") for i in range(64)], "file string, code string").coalesce(1)
    flows = dataflow.follow(one)
    assert flows.select(F.input_file_name()).distinct().count() > 1
    for made in (dataflow.statements(flows), dataflow.assets(flows), dataflow.other_calls(flows)):
        assert "MapIn" not in made._jdf.queryExecution().executedPlan().toString()


def test_functions_are_found_in_the_order_of_a_walk():
    code = "def a():\n  def b(): pass\nclass C:\n  def d(self): pass\ntry:\n  pass\nexcept E:\n  def e(): pass\nelse:\n  async def g(): pass\nmatch x:\n  case 1:\n    def h(): pass\n  case _:\n    if y:\n      def i(): pass\n    else:\n      def j(): pass\nwith k:\n  def l(): pass\nfor m in n:\n  def o(): pass\n"
    tree = ast.parse(code)
    assert flow.defined(tree) == [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
