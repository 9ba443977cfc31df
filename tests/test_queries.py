"""Every registered query of the engine against its DuckDB twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "part customer events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(plain(tuple(r)) for r in df.select(*cols).collect())
    assert got
    if name in catalogue.ORACLES:
        cur = con.execute(catalogue.ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        rows = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
        assert got == sorted(map(plain, rows))
