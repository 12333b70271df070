"""Every catalogue query against its SQL, on the smallest data."""

import os

import pytest

from marlstone.plans import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    r = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall())
    assert sorted(names) == columns and got == want
