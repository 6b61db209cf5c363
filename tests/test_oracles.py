"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tessella import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])
    if name not in registry.oracles():
        return
    rel = con.sql(registry.oracles()[name])
    names = list(rel.columns)
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=lambda r: [(x is None, str(x)) for x in r])
    assert got == want


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
