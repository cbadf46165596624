"""Every named query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from lexmill import catalog


def canon(v):
    if v is None:
        return "N"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, sql, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(tuple(canon(v) for v in r) for r in df.select(columns).collect())
    if name not in catalog.ORACLE:
        assert rows
        return
    r = sql.execute(catalog.ORACLE[name])
    own = [x[0] for x in r.description]
    assert sorted(own) == columns
    assert rows == sorted(tuple(canon(t[own.index(c)]) for c in columns) for t in r.fetchall())
