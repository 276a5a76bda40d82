"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from larkmill import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def normal(frame, columns):
    def cell(v):
        return "" if v is None or v != v else format(v, ".12g") if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(plans.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert normal(got, columns) == normal(want, columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
