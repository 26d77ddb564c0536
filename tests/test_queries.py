"""Every registered query of the engine against its DuckDB equivalent on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return connection


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12)
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).columns
