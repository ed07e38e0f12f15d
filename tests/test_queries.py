import os

import duckdb
import pytest

from quire.plans import element_queries, source_queries, stream_queries  # noqa: F401  they register their queries
from quire.plans import layout_queries as L

DIR = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", list(L.queries()))
def test_query(spark, con, name):
    df = L.queries()[name](spark, DIR)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    assert got or name == "ink_bounds"
    if name in L.oracle_sql():
        rel = con.sql(L.oracle_sql()[name])
        assert sorted(rel.columns) == sorted(df.columns)
        names = ", ".join(f'"{c}"' for c in sorted(df.columns))
        want = sorted((tuple(plain(v) for v in r) for r in rel.project(names).fetchall()), key=str)
        assert got == want


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= len(L.queries())
