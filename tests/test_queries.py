"""Every registered query of the library against its SQL on DuckDB, over the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = db.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_flagship():
    assert registry.FLAGSHIP in registry.queries() and registry.FLAGSHIP in registry.oracle_sql()


def test_redacted_of_long_numbers(spark, tmp_path):
    """i1_redacted: customers' numbers of six digits and more behind a country code are no phone."""
    keys = ", ".join(f"({k}::bigint)" for k in (1, 999, 99_999, 100_000, 100_001, 100_002, 100_003, 899_997, 12_345_677))
    con = duckdb.connect()
    con.execute(f"create table customer as select * from (values {keys}) v(c_custkey)")
    con.execute(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    got = [tuple(r) for r in registry.queries()["i1_redacted"](spark, str(tmp_path)).orderBy("c_custkey").collect()]
    assert got == con.execute(f"select * from ({registry.oracle_sql()["i1_redacted"]}) order by 1").fetchall()
