"""Every market query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyworks import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value.item() if hasattr(value, "item") else value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    rows = frame.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in frame.columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert sorted(tuple(map(plain, r)) for r in rows) == want
