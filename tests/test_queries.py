"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.plans import registry
from tests.conftest import SF

TABLES = [f[:-8] for f in sorted(os.listdir(SF)) if f.endswith(".parquet")] if os.path.isdir(SF) else []


def rows(df):
    cell = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(cell(r[c]) for c in sorted(r)) for r in df), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]
    if name not in registry.SQL:
        assert got
        return
    cur = duck.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert rows(got) == rows([dict(zip(names, r)) for r in cur.fetchall()])
    assert not got or sorted(got[0]) == sorted(names)
