"""Every query runs on the smallest tables; those with SQL agree with DuckDB."""

import decimal
import os

import pytest

from corpusweave.plans import catalogue

DIR = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are absent")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(str(norm(r[c])) for c in cols) for r in df.collect())
    if name not in catalogue.SQL:
        assert got
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.execute(f"create view {t.removesuffix('.parquet')} as from '{DIR}/{t}'")
    rel = con.sql(catalogue.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted(tuple(str(norm(r[i])) for i in at) for r in rel.fetchall())
