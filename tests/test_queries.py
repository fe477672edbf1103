"""Every query of the core against its SQL in DuckDB, over whole tables."""

import os
from pathlib import Path

import duckdb
import pytest

from quillmere import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    sql = Q.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
