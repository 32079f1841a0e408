"""Every query of the subpackage with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from evimatch.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    duck.execute("set timezone='UTC'")
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    plain = lambda row: repr([round(x, 9) if isinstance(x, float) else x for x in row])
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(plain, got.select(*columns).collect())) == sorted(map(plain, want.fetchall()))
