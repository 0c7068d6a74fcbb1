"""The queries with SQL against that SQL, on the smallest data set."""

import glob
import os

import duckdb
import pytest

from paidup.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test data are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    result = db.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in result.description)
    places = [[c[0] for c in result.description].index(c) for c in columns]
    want = sorted(tuple(str(row[i]) for i in places) for row in result.fetchall())
    got = registry.queries()[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert sorted(tuple(map(str, row)) for row in got.select(columns).collect()) == want
