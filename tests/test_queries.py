"""Every registered graph query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest
from graph_data import SF

from tiergraph.plans import queries as q


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(q.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).to_numpy().tolist() for x in (got, want))
    assert a == b


def test_all_have_sql():
    assert set(q.QUERIES) == set(q.ORACLES)
