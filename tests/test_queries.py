"""Every registered query against its SQL, on the smallest given tables."""

import glob
import os

import pytest

import __spark_entry__ as registered

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def plain(rows):
    def value(v):
        return float(f"{v:.9g}") if isinstance(v, float) or hasattr(v, "as_tuple") else v

    return sorted((tuple(value(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = registered.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = plain(df.select(*[f"`{c}`" for c in columns]).collect())
    assert found
    sql = registered.oracle_sql().get(name)
    if sql is None:  # held against brute force in the tests of its own
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == plain(tuple(row[i] for i in order) for row in result.fetchall())


def test_entry(spark):
    assert registered.entry(spark).columns[-3:] == ["effective_from", "effective_to", "is_current"]
