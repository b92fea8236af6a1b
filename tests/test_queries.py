"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from barloom.catalog import load_all

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


def norm(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert not any(isinstance(v, float) and (math.isnan(v) or math.isinf(v)) for r in got for v in r)
    assert got == want
