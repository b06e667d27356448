"""Registered queries over what statements consist of: broken statements of many kinds, unions, joins and nested queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.operators import syntax
from tributary.plans import corpus
from tributary.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_N = "CAST(c_nationkey AS STRING)"
#: Broken statements by kind, with the rule each breaks and the token where it shows; @ stands for the row's nation.
BROKEN = (
    ("INSERT INTO mart.b SELECT a FROM WHERE x = @;", "missing_source", "WHERE"),
    ("INSERT INTO mart.b SELECT a + FROM src.n@;", "missing_expression", "FROM"),
    ("INSERT INTO mart.b SELECT FROM src.n@;", "missing_items", "FROM"),
    ("INSERT INTO mart.b SELECT a b c d FROM src.n@ y z;", "unexpected_word", "c"),
    ("INSERT INTO mart.b SELECT a FROM src.n@ JOIN ON a = b;", "missing_source", "ON"),
    ("INSERT INTO mart.b SELECT sum( FROM src.n@);", "missing_expression", "FROM"),
    ("INSERT INTO mart.b SELECT a, b, FROM src.n@;", "trailing_comma", "FROM"),
    ("INSERT INTO mart.b SELECT ~a FROM src.n@;", "unclosed_literal", "~"),
    ("UPDATE mart.b a = @;", "missing_set", "="),
    ("MERGE INTO mart.b USING src.n@;", "missing_condition", ""),
    ("INSERT INTO mart.b SELECT a FROM src.n@ WHERE (b = 1;", "unclosed_parenthesis", ""),
    ("INSERT INTO mart.b SELECT CASE WHEN a = @ THEN 1 FROM src.x;", "incomplete_case", "FROM"),
    ("INSERT INTO mart.b SELECT a FROM src.n@ GROUP BY a WHERE b = 1;", "clause_order", "WHERE"),
    ("INSERT INTO SELECT a FROM src.n@;", "missing_target", "SELECT"),
    ("INSERT INTO mart.b SELECT a FROM src.n@);", "unopened_parenthesis", ")"),
    ("INSERT INTO mart.b SELECT a, @, ;", "trailing_comma", ""),
)
_WHICH = "CAST(c_custkey % 40 AS INT)"


def _text(statement: str) -> str:
    quoted = statement.replace("'", "''").replace("~", "' || chr(39) || '").replace("@", f"' || {_N} || '")
    return f"'{quoted}'"


_CASES = " ".join(f"WHEN {2 * k} THEN {_text(s)}" for k, (s, _, _) in enumerate(BROKEN))
#: Two of five statements are broken ones, the others those of the corpus.
SPOILED = f"CASE {_WHICH} {_CASES} ELSE {corpus.STMT} END"
_RULES = ", ".join(f"({2 * k}, '{rule}', '{near.replace('~', chr(39) * 2)}')" for k, (_, rule, near) in enumerate(BROKEN))


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(f"{corpus.FILE} AS file", f"{corpus.POS} AS pos", f"{SPOILED} AS stmt")


def statement_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first defect of each broken statement; whole ones have none."""
    return syntax.defects(syntax.read(_spoiled(spark, sf_dir)))


def valid_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole writes; files without any keep what is not cut off after a comma."""
    return syntax.valid_writes(_spoiled(spark, sf_dir))


#: A union with a join, a CTE over a derived table, and an update, one after the other.
_NESTED = (
    "INSERT INTO mart.u@ SELECT s.a AS x, s.b + d.c AS y FROM src.n@ s JOIN dim.d d ON s.k = d.k AND d.v > 0 UNION ALL SELECT e, 1 FROM src.m@;",
    "WITH w AS (SELECT q.k, q.total FROM (SELECT k, sum(amount) AS total FROM src.n@ GROUP BY k) q) INSERT INTO mart.w@ (key, amount) SELECT w.k, total FROM w;",
    "UPDATE mart.p@ SET a = b + 1, c = 2 WHERE k IN (SELECT k FROM src.n@);",
    "MERGE INTO mart.g@ USING (SELECT k, v FROM src.n@) s ON s.k = mart.g@.k WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (k) VALUES (1);",
)
_NEST = "CAST(c_custkey % 4 AS INT)"
NESTED = f"CASE {_NEST} " + " ".join(f"WHEN {k} THEN {_text(s)}" for k, s in enumerate(_NESTED)) + " END"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.read(table(spark, sf_dir, "customer").selectExpr(f"{corpus.FILE} AS file", f"{corpus.POS} AS pos", f"{NESTED} AS stmt"))


def branch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column edges of every branch of a union, of CTE inserts, updates and merges."""
    return syntax.column_edges(_nested(spark, sf_dir))


def physical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column edges followed through CTEs and derived tables to the tables."""
    return syntax.physical_edges(_nested(spark, sf_dir))


def join_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.join_predicates(_nested(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (statement_defects, valid_writes, branch_edges, physical_edges, join_predicates)}

_ROWS = f"SELECT {corpus.FILE} AS file, {corpus.POS} AS pos, {_NEST} AS kind, {_N} AS n FROM customer"


def _answers(columns: str, rows: tuple) -> str:
    """SQL of answers by kind; @ stands for the row's nation, null for null."""
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(shown(v) for v in row) + ")" for row in rows)
    names = [c.strip() for c in columns.split(",")]
    chosen = ", ".join(f"replace({c}, '@', n) AS {c}" if c not in ("branch", "nth") else c for c in names[1:])
    return f"SELECT r.file, r.pos, {chosen} FROM ({_ROWS}) r JOIN (VALUES {values}) t({columns}) ON t.kind = r.kind"


ORACLE_SQL |= {
    "statement_defects": f"SELECT {corpus.FILE} AS file, {corpus.POS} AS pos, rule, near FROM customer JOIN (VALUES {_RULES}) t(which, rule, near) ON which = {_WHICH}",
    "valid_writes": f"""WITH s AS (SELECT {corpus.FILE} AS file, {corpus.POS} AS pos, {SPOILED} AS stmt, {_WHICH} AS which FROM customer),
 graded AS (SELECT *, CASE WHEN which % 2 = 1 OR which >= {2 * len(BROKEN)} THEN 2 WHEN which = {2 * len(BROKEN) - 2} THEN 0 ELSE 1 END AS grade FROM s),
 best AS (SELECT *, max(grade) OVER (PARTITION BY file) AS top FROM graded) SELECT file, pos, stmt FROM best WHERE grade = top""",
    "branch_edges": _answers("kind, target, target_col, source_col, branch", (
        (0, "mart.u@", "x", "s.a", 0), (0, "mart.u@", "y", "s.b", 0), (0, "mart.u@", "y", "d.c", 0), (0, "mart.u@", "x", "e", 1), (0, "mart.u@", "y", "<derived>", 1),
        (1, "mart.w@", "key", "w.k", 0), (1, "mart.w@", "amount", "total", 0), (2, "mart.p@", "a", "b", 0), (2, "mart.p@", "c", "<derived>", 0), (3, "mart.g@", "v", "s.v", 0),
    )),
    "physical_edges": _answers("kind, target, target_col, source, source_col", (
        (0, "mart.u@", "x", "src.n@", "a"), (0, "mart.u@", "y", "src.n@", "b"), (0, "mart.u@", "y", "dim.d", "c"), (0, "mart.u@", "x", "src.m@", "e"), (0, "mart.u@", "y", None, "<derived>"),
        (1, "mart.w@", "key", "src.n@", "k"), (1, "mart.w@", "amount", "src.n@", "amount"), (2, "mart.p@", "a", None, "b"), (2, "mart.p@", "c", None, "<derived>"), (3, "mart.g@", "v", "src.n@", "v"),
    )),
    "join_predicates": _answers("kind, nth, predicate", ((0, 0, "s.k = d.k AND d.v > 0"), (3, 0, "s.k = mart.g@.k"))),
}
