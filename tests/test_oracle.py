"""Every query with SQL gives the rows and the kinds of columns that DuckDB gives on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from weftline.queries import load

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = load()
KINDS = {"bigint": "long", "integer": "int", "varchar": "string", "double": "double", "boolean": "boolean", "timestamp": "timestamp"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def plain(value):
    if isinstance(value, (decimal.Decimal, float)):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    return value if value is None or isinstance(value, (int, str)) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = duck.execute(SQL[name])
    described = [(d[0], str(d[1]).lower()) for d in result.description]
    assert sorted(d[0] for d in described) == columns
    kinds = {n: t.split("_")[0].replace("bigint", "long") for n, t in frame.dtypes}
    assert {n: KINDS.get(t, t) for n, t in described} == kinds
    at = [[d[0] for d in described].index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in at] for r in result.fetchall()), key=repr)
    got = sorted(([plain(v) for v in r] for r in frame.select(*columns).collect()), key=repr)
    assert got == want
