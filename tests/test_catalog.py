"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from docloom.plans import catalog
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(df: pd.DataFrame):
    def one(v):
        if hasattr(v, "tolist") and not isinstance(v, pd.Timestamp):
            v = v.tolist()
        if isinstance(v, list | tuple):
            return str([one(x) for x in v])
        if v is None or v is pd.NaT or v != v:
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(map(tuple, df[sorted(df.columns)].map(one).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
