"""Every query of the catalogue against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from symweave.plans import catalog

DATA = "/root/testdata/sf0.001"


def rows(frame):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "-") in "iufb" else str(v)

    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(found)
    if name in catalog.ORACLES:
        wanted = duck.execute(catalog.ORACLES[name]).fetchdf()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
