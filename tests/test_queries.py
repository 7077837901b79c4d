"""Every core query against DuckDB on the smallest tables, and the entry's shape."""

import decimal
import glob
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
CORE = {n: f for m in entry._core_modules() for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, oracle, name):
    df = CORE[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = oracle.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_read_only_what_they_need(spark, sf):
    plan = CORE["ref_p8_heuristics"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    plan = CORE["ref_s1_find_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan and "PushedFilters" in plan
