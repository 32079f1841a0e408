"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from evimatch.plans import catalogue
from evimatch.plans.views import BASE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in BASE:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a = sorted(repr([_plain(v) for v in r]) for r in got.select(*columns).collect())
    b = sorted(repr([_plain(v) for v in r]) for r in want.fetchall())
    assert a == b


def test_nothing_is_confidently_wrong(spark):
    assert catalogue.QUERIES["match_auto_accept"](spark, SF).first().wrong == 0
