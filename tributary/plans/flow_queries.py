"""Registered queries over what scripts do with DataFrames: one script for each customer, of six kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import dataflow, syntax
from tributary.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_CHAIN = '''from pyspark.sql import functions as F
from pyspark.sql.functions import col
base = spark.sql("SELECT id, cust, amount FROM src.orders_@ WHERE amount > 0")
rich = base.withColumn("net", col("amount") * 2)
names = spark.table("dim.customer_@").select("key", F.upper("name").alias("uname"))
both = rich.join(names, rich.cust == names.key, "left")
total = both.groupBy("uname").agg(F.sum("net").alias("total"), F.count("*").alias("n"))
total.write.mode("overwrite").saveAsTable("mart.totals_@")
rich.filter(rich.net > 10).write.parquet("s3a://out/rich_@.parquet")
'''
_CALLS = '''def load(name, source="src.default_@"):
    got = spark.table(source)
    got.write.insertInto(f"stage.{name}")
    return got
def both(a):
    load(a, "src.one_@")
    return load(a + "_two")
def again(n):
    load("r_@", n)
    return again(n)
def idle(path):
    spark.read.csv(path).write.saveAsTable("raw.idle_@")
out = both("t_@")
out.select("x").write.saveAsTable("mart.x_@")
again("src.r_@")
'''
_LOOPS = '''TABLES = ["a", "b"]
for t in TABLES:
    for year in range(2023, 2025):
        spark.sql(f"INSERT INTO hist.{t}_@ SELECT v FROM src.{t}_{year}")
for name, source in {"m": "src.m_@", "n": "src.n_@"}.items():
    spark.table(source).write.saveAsTable("mart." + name)
for day in range(32):
    spark.table("src.days_@").write.saveAsTable(f"mart.day_{day}")
for f in list_files():
    spark.read.json(f).write.saveAsTable("mart.files_@")
'''
_SINKS = '''df = spark.read.option("header", True).csv("/in/users_@.csv")
df.cache()
df.show()
print(df.count())
audit(df)
df.write.format("kafka").option("topic", "topic_@").save()
df.write.format("org.neo4j.spark.DataSource").option("labels", ":User:Key@").option("node.keys", "id, name").save()
df.write.format("jdbc").option("dbtable", "db.users_@").mode("append").save()
df.createOrReplaceTempView("users_@")
spark.sql("CREATE MATERIALIZED VIEW mv_@ AS SELECT id FROM users_@")
spark.sql("REFRESH MATERIALIZED VIEW mv_@")
spark.sql("CREATE OR REPLACE TEMP VIEW v_@ AS SELECT id FROM mv_@")
spark.sql("MSCK REPAIR TABLE db.users_@")
write_ndw(dataframe=df, database="ndw", table="users_@")
body = requests.get("https://api.example.org/v1/@")
'''
_UNION = '''w = Window.partitionBy("id").orderBy(F.col("ts").desc())
a = spark.read.parquet("s3a://in/a_@").select("id", "ts", "v")
b = spark.read.table("src.b_@").selectExpr("id", "ts", "v2 AS v")
a = a.union(b).distinct()
latest = a.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
labelled = latest.withColumn("lbl", F.when(F.col("v") > 1, "hi").otherwise("lo")).withColumnRenamed("v", "value")
labelled.write.format("delta").save("/lake/latest_@")
'''
_BROKEN = "def f(:\n"
KINDS = (_CHAIN, _CALLS, _LOOPS, _SINKS, _UNION, _BROKEN)


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, code)."""
    key = F.col("c_custkey").cast("string")
    code = F.array(*[F.lit(k) for k in KINDS])[(F.col("c_custkey") % len(KINDS)).cast("int")]
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("job_"), key).alias("file"), F.replace(code, F.lit("@"), key).alias("code"))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.follow(scripts(spark, sf_dir))


def flow_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement for each write: chains as CTEs, calls entered, loops expanded."""
    return dataflow.statements(_flows(spark, sf_dir)).select("file", "pos", "stmt", "scope", "loop")


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column edges of these statements, from the tables."""
    made = dataflow.statements(_flows(spark, sf_dir)).select("file", "pos", "stmt")
    return syntax.edges_by_shape(made).select("file", "target", "target_col", "source", "source_col").distinct()


def flow_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.rejects(_flows(spark, sf_dir))


def typed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.assets(_flows(spark, sf_dir)).withColumn("columns", F.array_join("columns", ","))


def other_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.other_calls(_flows(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (flow_statements, flow_edges, flow_rejects, typed_assets, other_calls)}

_JOBS = f"SELECT 'job_' || CAST(c_custkey AS VARCHAR) AS file, CAST(c_custkey AS VARCHAR) AS n, CAST(c_custkey % {len(KINDS)} AS INT) AS kind FROM customer"
_NUMBERS = ("pos", "step", "line")


def _answers(columns: str, rows: tuple) -> str:
    """SQL of answers by kind; @ stands for the customer's key, null for null."""
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(shown(v) for v in row) + ")" for row in rows)
    chosen = ", ".join(c if c in _NUMBERS else f"replace({c}, '@', n) AS {c}" for c in columns.split(", ")[1:])
    return f"SELECT j.file, {chosen} FROM ({_JOBS}) j JOIN (VALUES {values}) t({columns}) ON t.kind = j.kind"


_ALL = "*", None, "<derived>"
ORACLE_SQL |= {
    "flow_statements": _answers("kind, pos, stmt, scope, loop", (
        (0, 6, "WITH base AS (SELECT id, cust, amount FROM src.orders_@ WHERE amount > 0), rich AS (SELECT id, cust, amount, amount * 2 AS net FROM base), names AS (SELECT key, upper(name) AS uname FROM dim.customer_@), both AS (SELECT * FROM rich AS l LEFT JOIN names AS r ON l.cust = r.key), total AS (SELECT uname, sum(net) AS total, count(*) AS n FROM both GROUP BY uname) INSERT INTO mart.totals_@ SELECT uname, total, n FROM total;", "", ""),
        (0, 8, 'WITH base AS (SELECT id, cust, amount FROM src.orders_@ WHERE amount > 0), rich AS (SELECT id, cust, amount, amount * 2 AS net FROM base), step_7 AS (SELECT id, cust, amount, net FROM rich WHERE net > 10) INSERT INTO "s3a://out/rich_@_parquet" SELECT id, cust, amount, net FROM step_7;', "", ""),
        (1, 1, "INSERT INTO stage.t_@ SELECT * FROM src.one_@;", "both>load", ""), (1, 3, "INSERT INTO stage.t_@_two SELECT * FROM src.default_@;", "both>load", ""),
        (1, 5, "INSERT INTO mart.x_@ SELECT x FROM src.default_@;", "", ""), (1, 7, "INSERT INTO stage.r_@ SELECT * FROM src.r_@;", "again>load", ""),
        (1, 10, 'INSERT INTO raw.idle_@ SELECT * FROM "{path}";', "idle", ""),
        *((2, 2 * i + k, f"INSERT INTO hist.{t}_@ SELECT v FROM src.{t}_{2023 + k};", "", f"t={t},year={2023 + k}") for i, t in enumerate("ab") for k in (0, 1)),
        (2, 5, "INSERT INTO mart.m SELECT * FROM src.m_@;", "", "(name, source)=m;src.m_@"), (2, 7, "INSERT INTO mart.n SELECT * FROM src.n_@;", "", "(name, source)=n;src.n_@"),
        (2, 10, "INSERT INTO mart.day_{day} SELECT * FROM src.days_@;", "", ""), (2, 14, 'INSERT INTO mart.files_@ SELECT * FROM "{f}";', "", ""),
        *((3, pos, f'INSERT INTO {t} SELECT * FROM "/in/users_@_csv";', "", "") for pos, t in ((6, "topic_@"), (7, "User"), (7, "Key@"), (8, "db.users_@"), (9, "#users_@"), (14, "ndw.users_@"))),
        (3, 10, "INSERT INTO mv_@ SELECT id FROM #users_@;", "", ""), (3, 12, "INSERT INTO #v_@ SELECT id FROM mv_@;", "", ""),
        (4, 11, 'WITH a AS (SELECT id, ts, v FROM "s3a://in/a_@"), b AS (SELECT id, ts, v2 AS v FROM src.b_@), step_4 AS (SELECT id, ts, v FROM a UNION ALL SELECT id, ts, v FROM b), a_2 AS (SELECT DISTINCT id, ts, v FROM step_4), step_6 AS (SELECT id, ts, v, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS rn FROM a_2), step_7 AS (SELECT id, ts, v, rn FROM step_6 WHERE rn = 1), latest AS (SELECT id, ts, v FROM step_7), step_9 AS (SELECT id, ts, v, CASE WHEN v > 1 THEN \'hi\' ELSE \'lo\' END AS lbl FROM latest), labelled AS (SELECT id, ts, v AS value, lbl FROM step_9) INSERT INTO "/lake/latest_@" SELECT id, ts, value, lbl FROM labelled;', "", ""),
    )),
    "flow_edges": _answers("kind, target, target_col, source, source_col", (
        (0, "mart.totals_@", "uname", "dim.customer_@", "name"), (0, "mart.totals_@", "total", "src.orders_@", "amount"), (0, "mart.totals_@", "n", None, "<derived>"), *((0, "s3a://out/rich_@_parquet", c, "src.orders_@", x) for c, x in (("id", "id"), ("cust", "cust"), ("amount", "amount"), ("net", "amount"))),
        *((1, t, *_ALL) for t in ("stage.t_@", "stage.t_@_two", "stage.r_@", "raw.idle_@")), (1, "mart.x_@", "x", "src.default_@", "x"),
        *((2, f"hist.{t}_@", "v", f"src.{t}_{y}", "v") for t in "ab" for y in (2023, 2024)), *((2, t, *_ALL) for t in ("mart.m", "mart.n", "mart.day_{day}", "mart.files_@")),
        *((3, t, *_ALL) for t in ("topic_@", "user", "key@", "db.users_@", "#users_@", "ndw.users_@")), (3, "mv_@", "id", "#users_@", "id"), (3, "#v_@", "id", "mv_@", "id"),
        *((4, "/lake/latest_@", c, s, x) for s, v in (("s3a://in/a_@", "v"), ("src.b_@", "v2")) for c, x in (("id", "id"), ("ts", "ts"), ("value", v), ("lbl", v))),
    )),
    "flow_rejects": _answers("kind, line, reason, detail", (
        (1, 10, "recursion", "again>again"), (2, 7, "loop_bound", "day: 32 iterations"), (2, 9, "loop_unknown", "f in list_files()"), (5, 0, "syntax", "SyntaxError: invalid syntax (<unknown>, line 1)"),
    )),
    "typed_assets": _answers("kind, step, line, access, kind_, asset, columns", (
        (0, 2, 5, "read", "table", "dim.customer_@", ""), (0, 6, 8, "write", "table", "mart.totals_@", ""), (0, 8, 9, "write", "path", "s3a://out/rich_@.parquet", ""),
        (1, 0, 2, "read", "table", "src.one_@", ""), (1, 1, 3, "write", "table", "stage.t_@", ""), (1, 2, 2, "read", "table", "src.default_@", ""), (1, 3, 3, "write", "table", "stage.t_@_two", ""),
        (1, 5, 14, "write", "table", "mart.x_@", ""), (1, 6, 2, "read", "table", "src.r_@", ""), (1, 7, 3, "write", "table", "stage.r_@", ""), (1, 9, 12, "read", "path", "{path}", ""), (1, 10, 12, "write", "table", "raw.idle_@", ""),
        *((2, 2 * i + k, 4, "write", "table", f"hist.{t}_@", "") for i, t in enumerate("ab") for k in (0, 1)), (2, 4, 6, "read", "table", "src.m_@", ""), (2, 5, 6, "write", "table", "mart.m", ""),
        (2, 6, 6, "read", "table", "src.n_@", ""), (2, 7, 6, "write", "table", "mart.n", ""), (2, 9, 8, "read", "table", "src.days_@", ""), (2, 10, 8, "write", "table", "mart.day_{day}", ""),
        (2, 13, 10, "read", "path", "{f}", ""), (2, 14, 10, "write", "table", "mart.files_@", ""),
        (3, 0, 1, "read", "path", "/in/users_@.csv", ""), (3, 6, 6, "write", "topic", "topic_@", ""), (3, 7, 7, "write", "label", "User", "id,name"), (3, 7, 7, "write", "label", "Key@", "id,name"),
        (3, 8, 8, "write", "table", "db.users_@", ""), (3, 9, 9, "write", "view", "#users_@", ""), (3, 10, 10, "write", "table", "mv_@", ""), (3, 11, 11, "refresh", "table", "mv_@", ""),
        (3, 12, 12, "write", "view", "#v_@", ""), (3, 14, 14, "write", "table", "ndw.users_@", ""), (3, 15, 15, "read", "url", "https://api.example.org/v1/@", ""),
        (4, 0, 2, "read", "path", "s3a://in/a_@", ""), (4, 2, 3, "read", "table", "src.b_@", ""), (4, 11, 7, "write", "path", "/lake/latest_@", ""),
    )).replace("AS kind_", "AS kind"),
    "other_calls": _answers("kind, step, line, name", ((2, 11, 9, "list_files"), (3, 5, 5, "audit"))),
}
