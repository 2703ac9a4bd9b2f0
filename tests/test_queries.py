"""Every query of the library, and its SQL run by DuckDB on the same tables."""

import duckdb
import pytest

from attesta.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert rows
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
        assert [found.columns[i] for i in order] == columns
        assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(x[i]) for i in order)) for x in found.fetchall())
