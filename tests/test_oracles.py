"""Every query with an oracle against DuckDB on the smallest tables; the others must return rows of a fixed schema."""

import duckdb
import pandas as pd
import pytest

from tracewright.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{DIR}/events.parquet'")
    return c


def rows(df):
    def one(v):
        if v is None or v is pd.NaT:
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
