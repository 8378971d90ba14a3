"""Every query of the extraction engine beside its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from docweft.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert mine
        return
    con.execute(ORACLES[name])
    have = [d[0] for d in con.description]
    assert sorted(have) == columns
    assert mine == sorted(repr(tuple(r[have.index(c)] for c in columns)) for r in con.fetchall())
