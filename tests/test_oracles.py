"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from bytequarry.plans import catalog


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or (isinstance(v, float) and pd.isna(v)):
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, tables, duck):
    got = catalog.QUERIES[name](spark, tables)
    want = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), names)
