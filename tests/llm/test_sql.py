"""Queries against their SQL, and that every registered query reads whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from zonescope.llm.oracles import ORACLES
from zonescope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(frame):
    def cell(x):
        return "NULL" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    got = QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(con.sql(ORACLES[name]).df())


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
