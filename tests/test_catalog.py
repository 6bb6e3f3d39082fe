"""Every registered evidence query agrees with its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from sparkwitness.plans.catalog import ORACLE, QUERIES
from sparkwitness.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None or isinstance(v, (bool, str)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE:
        assert got
        return
    r = duck.sql(ORACLE[name])
    at = [r.columns.index(c) for c in columns]
    assert sorted(r.columns) == columns
    assert got == sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())
