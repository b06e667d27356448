"""Every registered query with a SQL twin gives its rows."""

import glob
import os

import duckdb
import pytest

from tributary.plans import catalogue


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def rows(names, records):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return sorted(tuple("" if r[i] is None else repr(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in at) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned(spark, sf):
    """Filters and needed columns reach the scan."""
    plan = catalogue.QUERIES["retention_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "props" not in plan
    plan = catalogue.QUERIES["mart_master"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "c_acctbal" not in plan


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_without_twin(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
