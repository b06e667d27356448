"""Statement functions and the scanner on small texts."""

import pytest
from pyspark.sql import functions as F

from tributary.functions import scan
from tributary.functions import text as T


@pytest.fixture
def on(spark):
    def run(function, value):
        return spark.createDataFrame([(value,)], "s string").select(function(F.col("s")).alias("r")).first()["r"]

    return run


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (T.split_statements, "a;\n b ; c", ["a;", "b ;", "c"]),
        (T.write_kind, "  update t set a=1", "update"),
        (T.statement_kind, "WITH q AS (SELECT 1) INSERT INTO t SELECT * FROM q;", "with_insert"),
        (T.star_policy, "INSERT INTO t SELECT * FROM s;", "star"),
        (T.star_policy, "UPDATE t SET a = 1;", None),
        (T.insert_target, "INSERT INTO Db.T SELECT a FROM s;", "db.t"),
        (T.source_assets, "INSERT INTO t SELECT a FROM S JOIN #x ON 1=1 JOIN s ON 1=1;", ["s", "#x"]),
        (T.normalize_target, "'Db.T' partition (d)", "db.t'"),
        (T.match_key, " #Tmp ", "tmp"),
        (T.tsql_placeholders, "d = '{V}' AND e = {W}", "d = @V AND e = @W"),
        (T.visual_placeholders, "d = @AS_OF AND e = @AS_OF_DATE", "d = '{as_of}' AND e = '{as_of_date}'"),
        (T.strip_comments, "a -- x\nb /* y\nz */ c", "a \nb  c"),
        (T.space_partition_by, "OVER (PARTITION BYID_NUMBER)", "OVER (PARTITION BYID_NUMBER)".replace("BYID", "BY ID")),
        (T.close_subquery, "INSERT INTO t SELECT a FROM (SELECT a FROM b JT;", "INSERT INTO t SELECT a FROM (SELECT a FROM b) JT;"),
        (T.collapse_join_wrapper, "x ) AS q ) AS q ON 1=1", "x ) AS q ON 1=1"),
        (T.strip_partition, "INSERT INTO t PARTITION (d) SELECT a FROM s;", "INSERT INTO t SELECT a FROM s;"),
        (T.tidy_partition, "INSERT INTO t PARTITION (d) PARTITION (d) SELECT a FROM s;", "INSERT INTO t PARTITION (d) SELECT a FROM s;"),
        (T.cut_where_on_temp, "INSERT INTO t SELECT a FROM #x WHERE b = 1;", "INSERT INTO t SELECT a FROM #x;"),
        (T.cut_to_write, "Explanation. INSERT INTO t SELECT a FROM s;", "INSERT INTO t SELECT a FROM s;"),
        (T.sanitize, "```sql\nSELECT 1\n```\n<|im_end|>", "SELECT 1"),
        (T.is_noop_self_write, "INSERT INTO x SELECT * FROM #X;", True),
        (T.is_noop_self_write, "INSERT INTO x SELECT * FROM y;", False),
        (T.looks_complete, "INSERT INTO t SELECT a, b, ;", False),
        (T.output_column, "sum(a) AS total", "total"),
        (T.synthetic_temp_chain, "INSERT INTO #temp_table_2 SELECT a FROM #temp_table_1;", True),
    ],
)
def test_text(on, function, given, wanted):
    assert on(function, given) == wanted


def test_update_becomes_insert(on):
    got = on(T.update_to_insert, "UPDATE dim SET end_date = '2020-01-01' WHERE cif_key IN (SELECT cif_key FROM staging) AND '2020-01-02' BETWEEN start_date AND end_date")
    assert got == "INSERT INTO dim\nSELECT tgt.cif_key, tgt.end_date, tgt.start_date\nFROM dim AS tgt\nJOIN staging AS src1 ON 1=1;"


def test_retarget_and_case(on):
    assert on(lambda s: T.retarget(s, F.lit("a.b")), "INSERT INTO #t SELECT x FROM #t2;") == "INSERT INTO a.b SELECT x FROM #t2;"
    assert on(lambda s: T.enforce_case(s, F.array(F.lit("Db.T1"), F.lit("Db.T"))), "from db.t1 join db.t join db.t2") == "from Db.T1 join Db.T join db.t2"


def test_substitute_escapes_values(on):
    values = F.array(F.struct(F.lit("X").alias("name"), F.lit("a$1\\b").alias("value")))
    assert on(lambda s: T.substitute(s, values), "{X} X XY") == "a$1\\b a$1\\b XY"


def test_nulls_stay_null(on):
    for function in (T.normalize_asset, T.strip_comments, T.split_statements, T.source_assets, T.star_policy):
        assert on(function, None) is None


def test_scanner():
    assert scan.split_script("a;b ';' c; -- ;\nd") == ["a;", "b ';' c;", "-- ;\nd"]
    assert scan.balanced("(a ')' )") and not scan.balanced("(()")
    assert scan.split_items("a, f(b, c) AS d, 'x,y'") == ["a", "f(b, c) AS d", "'x,y'"]
    assert scan.strip_where("INSERT INTO t SELECT a FROM (SELECT a FROM s WHERE x IN (1)) q WHERE y = 1\nGROUP BY a;") == "INSERT INTO t SELECT a FROM (SELECT a FROM s) q GROUP BY a;"
    assert scan.strip_where("UPDATE t SET a = 1 WHERE b = 2") == "UPDATE t SET a = 1 WHERE b = 2;"
    assert scan.uniquify_aliases("SELECT c.* FROM (x) AS c JOIN (y) AS c JOIN (z) AS c") == "SELECT c_1.* FROM (x) AS c_1 JOIN (y) AS c_2 JOIN (z) AS c"
    assert scan.projections("INSERT INTO t SELECT s.a AS a1, s.b + 1 b1 FROM s") == [("s.a", "a1"), ("s.b + 1", "b1")]
