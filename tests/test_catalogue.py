"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallyforge.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a, b = (x[names].astype(str).sort_values(names).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE_SQL:
        same(got, duck.execute(catalogue.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).first().n > 0
