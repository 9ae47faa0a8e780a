"""Every query with an oracle gives the oracle's rows; the others run."""

import os

import duckdb
import numpy as np
import pytest

from corpusloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v != v else (v.item() if hasattr(v, "item") else v)
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(round(x, 6) if isinstance(x := clean(v), float) else (str(x.tolist()) if isinstance(x, np.ndarray) else x) for v in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    want = con.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) < 2e-6) for u, v in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
