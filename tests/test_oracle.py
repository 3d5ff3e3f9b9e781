"""Every core query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from starloom.queries import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def norm(v):
    if isinstance(v, float):
        assert not math.isnan(v)  # NaN equals nothing, not even itself
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in registry.SQL:
        assert got
        return
    r = con.execute(registry.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
