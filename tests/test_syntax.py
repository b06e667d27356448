"""Reading statements: defects, trees, edges through nesting."""

import pyarrow as pa
import pytest

from tributary.functions import clauses
from tributary.functions.clauses import CLAUSE, read
from tributary.operators import syntax
from tributary.plans.syntax_queries import BROKEN

WHOLE = [
    "INSERT INTO mart.t PARTITION (d) SELECT a, b AS bb, row_number() OVER (PARTITION BY a, b ORDER BY c DESC) rn FROM src.{STAGE} s LEFT OUTER JOIN dim.d ON s.a = d.a AND d.x BETWEEN 1 + 2 AND 5 WHERE s.d = '{DT}' AND k NOT IN (SELECT k FROM q) GROUP BY a HAVING count(*) > 1;",
    "WITH c AS (SELECT * FROM x), d AS (SELECT a FROM c) INSERT INTO t (a, b) SELECT a, cast(b AS decimal(22,3)) FROM d UNION ALL SELECT x, y FROM (SELECT x, y FROM z LIMIT 5) q;",
    "UPDATE t tgt SET end_date = date_add('x', -1), b = c FROM s WHERE k IN (SELECT k FROM s)",
    "MERGE INTO t USING s ON t.k = s.k WHEN MATCHED AND s.x > 1 THEN DELETE WHEN NOT MATCHED BY TARGET THEN INSERT (a) VALUES (1);",
    "INSERT INTO \"s3a://x/y\" SELECT * FROM #tmp_1; -- done",
    "INSERT INTO t SELECT -a, s.*, count(DISTINCT b), CASE a WHEN 1 THEN 'x' ELSE NULL END lbl, INTERVAL 1 day, a IS NOT NULL AS f, date '2024-01-01' FROM a, b AS c CROSS JOIN d",
    "INSERT INTO t VALUES (1, 'a;b'), (2, 'it''s')",
    "INSERT INTO t (SELECT a FROM x) UNION (SELECT b FROM y ORDER BY b NULLS LAST)",
    "INSERT OVERWRITE TABLE t SELECT left(a, 3), b FROM (a JOIN b USING (k)) LATERAL VIEW explode(xs) q AS x WHERE a LIKE '%x' OR NOT EXISTS (SELECT 1 FROM z)",
]


@pytest.mark.parametrize("stmt", WHOLE)
def test_whole(stmt):
    assert read(stmt)[1:3] == (None, None)


@pytest.mark.parametrize(("stmt", "rule", "near"), BROKEN)
def test_broken(stmt, rule, near):
    assert read(stmt.replace("~", "'").replace("@", "7"))[1:3] == (rule, near.replace("~", "'"))


def test_odd_texts():
    assert read("")[1] == read(" ; ")[1] == read("hello there")[1] == "not_a_statement"
    assert read("SELECT " + "(" * 3000 + "1" + ")" * 3000)[1] == "too_deep"
    long = "INSERT INTO t SELECT " + ", ".join(f"c{i} AS d{i}" for i in range(5000)) + " FROM s"
    assert read(long)[1] is None and len(read(long)[3]) == 5003


def test_tree():
    rows = [dict(zip(CLAUSE, r, strict=True)) for r in read(WHOLE[1])[3]]
    children = {r["child"]: r["clause"] for r in rows if r["child"] >= 0}
    assert sorted(children.values()) == ["cte", "cte", "from", "query"]
    assert all(r["parent"] in children for r in rows if r["clause"] == "item")
    main = next(r["child"] for r in rows if r["clause"] == "query")
    assert [(r["branch"], r["ord"], r["name"]) for r in rows if r["clause"] == "item" and r["parent"] == main] == [(0, 0, "a"), (0, 1, "cast(b AS decimal(22,3))"), (1, 0, "x"), (1, 1, "y")]


def frame(spark, *stmts):
    return syntax.read(spark.createDataFrame([("f", i, s) for i, s in enumerate(stmts)], "file string, pos int, stmt string"))


def test_tables(spark):
    reading = frame(spark, *WHOLE[:2], None, "INSERT INTO t SELECT a, FROM x")
    got = {r.pos: (r.t, r.s) for r in reading.select("pos", syntax.target_of().alias("t"), syntax.sources_of().alias("s")).collect()}
    assert got[0] == ("mart.t", ["src.{STAGE}", "dim.d", "q"]) and got[1] == ("t", ["x", "z"]) and got[2] == (None, None)
    assert {tuple(r) for r in syntax.defects(reading).collect()} == {("f", 3, "trailing_comma", "FROM")}
    assert reading.where(syntax.is_whole()).count() == 2
    assert syntax.column_edges(reading.where("pos > 1")).count() == 0
    assert syntax.clause_rows(reading).where("pos = 0 AND clause = 'where'").first().columns == ["s.d", "k"]


def test_edges_through_nesting(spark):
    deep = "INSERT INTO t SELECT x.c3 AS out, y.n FROM (SELECT c2 AS c3 FROM (SELECT c1 + k AS c2 FROM src.base b) q) x JOIN (SELECT * FROM src.other) y ON x.c3 = y.n"
    both = "INSERT INTO t SELECT a FROM p, q"
    got = {tuple(r)[2:] for r in syntax.physical_edges(frame(spark, deep, both)).collect()}
    assert got == {("t", "out", "src.base", "c1"), ("t", "out", "src.base", "k"), ("t", "n", "src.other", "n"), ("t", "a", None, "a")}
    assert syntax.physical_edges(frame(spark, deep), levels=1).where("source IS NULL").count() == 1
    edges = {tuple(r)[2:5] for r in syntax.column_edges(frame(spark, "INSERT INTO tgt SELECT s.a AS a1, s.b + 1 AS b1, 'k' AS c FROM src s UNION ALL SELECT u.x, u.y, u.z FROM u;", "SELECT 1")).collect()}
    assert edges == {("tgt", "a1", "s.a"), ("tgt", "b1", "s.b"), ("tgt", "c", "<derived>"), ("tgt", "a1", "u.x"), ("tgt", "b1", "u.y"), ("tgt", "c", "u.z")}


def test_equal_statements_are_read_and_made_into_rows_once():
    """A batch of one statement costs one statement; null, broken and whole ones keep their places."""
    whole, broken = "INSERT INTO t SELECT a FROM s;", "INSERT INTO t SELECT a, FROM s;"
    got = clauses.parsed.func(pa.array([whole, None, broken, whole] * 1000)).to_pylist()
    assert len(got) == 4000 and got[0] == got[3] == got[3999] and got[1] == dict.fromkeys(("kind", "rule", "near", "clauses"))
    assert [tuple(c.values()) for c in got[0]["clauses"]] == clauses.read(whole)[3]
    assert got[2]["rule"] == "trailing_comma" and [tuple(c.values()) for c in got[2]["clauses"]] == clauses.read(broken)[3]



def test_edges_by_shape_are_the_statements_own(spark, monkeypatch):
    """Statements that differ in their names' digits are read once; numbers, other digits and marks in texts are theirs."""
    odd = [
        "INSERT INTO t1 SELECT a1, a01 AS b1, a1 + 1 FROM s1 WHERE x = 1;", "INSERT INTO t2 SELECT a2, a02 AS b2, a2 + 1 FROM s2 WHERE x = 1;",
        "INSERT INTO t1 SELECT a1, a1 AS b1, a1 + 2 FROM s2;", "INSERT INTO t1 SELECT a2, a1 AS b1, 1e5, 1.5e3 FROM s1;", "INSERT INTO `t 9`.x1 SELECT {v1}2, A12, 'q1 7' AS q FROM \"s3a://in/a_7\" AS b7;",
        "WITH c1 AS (SELECT a1 AS x1 FROM s1), c2 AS (SELECT x1, y1.z2 FROM c1 JOIN y1 ON x1 = z2) INSERT INTO t1 SELECT c2.x1, z2, count(*) FROM c2;",
        "WITH c3 AS (SELECT a3 AS x3 FROM s3), c1 AS (SELECT x3, y3.z1 FROM c3 JOIN y3 ON x3 = z1) INSERT INTO t3 SELECT c1.x3, z1, count(*) FROM c1;",
        f"INSERT INTO t{clauses.MARKS[0]}1 SELECT é1 FROM s1;", f"INSERT INTO t1 SELECT a{clauses.MARKS[0]}, b1 FROM s1;", "UPDATE t8 SET a8 = b9 WHERE c = 8;", "SELECT a1 FROM", None, "",
        "INSERT INTO t SELECT " + ", ".join(f"c{i}" for i in range(70)) + " FROM s69;",
    ]
    rows = spark.createDataFrame([(f"f{i % 3}", i, s) for i, s in enumerate(odd)], "file string, pos int, stmt string")
    wanted = sorted(map(str, syntax.physical_edges(syntax.read(rows)).collect()))
    assert wanted and sorted(map(str, syntax.edges_by_shape(rows).collect())) == wanted
    monkeypatch.setattr(syntax, "MAX_BROADCAST_SHAPES", 0)
    assert sorted(map(str, syntax.edges_by_shape(rows).collect())) == wanted
    assert [clauses.shape_of(odd[k])[0] for k in (0, 5)] == [clauses.shape_of(odd[k])[0] for k in (1, 6)]
    assert clauses.shape_of("a1 1e5 .5 x2") == (f"a{clauses.MARKS[0]} 1e5 .5 x{clauses.MARKS[1]}", ["1", "2"])
    many = spark.range(3000).selectExpr("'f' file", "CAST(id AS INT) pos", "concat('INSERT INTO t', id, ' SELECT a FROM s', id) stmt")
    held = []
    real = syntax.read
    monkeypatch.setattr(syntax, "read", lambda t: held.append(t.count()) or real(t))
    assert syntax.edges_by_shape(many).count() == 3000 and held == [1]
