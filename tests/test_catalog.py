"""Each registered query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from docloom import catalog

DATA = "/root/testdata/sf0.001"


def cell(x):
    if x is None or str(x) in ("<NA>", "NaT", "nan"):
        return "~"
    if isinstance(x, bool) or not hasattr(x, "__float__"):
        return str(x)
    return "~" if math.isnan(float(x)) else repr(round(float(x), 6))


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
