"""Every ledger query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans.ledger_queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value is pd.NA:
        return "~"
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    try:
        return repr(round(float(value), 9))
    except (TypeError, ValueError):
        return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, wanted = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)
