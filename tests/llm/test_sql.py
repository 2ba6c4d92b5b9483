import glob
import os

import duckdb
import pytest

from wayfarer.llm import oracle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, SF), db.sql(oracle.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(tuple(r[k] for k in order) for r in want.fetchall())
