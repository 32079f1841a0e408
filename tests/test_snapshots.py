"""Dated catalogues: the newest snapshot of each set, and filters that reach the source."""

import glob

import pytest
from pyspark.sql import functions as F

from evimatch.operators import catalog
from evimatch.sources import snapshots


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("catalogue"))
    shape = "id long, name string, set_name string, num int, den int, hp int, year int"
    old = [(1, "Anvil", "A/1", 1, 2, 50, 1999), (2, "Bolt", "A/1", 2, 2, 60, 1999), (3, "Gear", "B", 1, 1, 70, 2001), (4, "Rod", None, 7, 9, None, None)]
    snapshots.write_snapshot(spark.createDataFrame(old, shape), at, "2024-01-01")
    snapshots.write_snapshot(spark.createDataFrame([(1, "Anvil Prime", "A/1", 1, 1, 55, 2000)], shape), at, "2024-02-01")
    return at


@pytest.mark.parametrize("day, want", [("2023-12-31", []), ("2024-01-31", ["Anvil", "Bolt", "Gear", "Rod"]), ("2024-02-01", ["Anvil Prime", "Gear", "Rod"]), (None, ["Anvil Prime", "Gear", "Rod"])])
def test_the_newest_of_each_set(spark, folder, day, want):
    assert sorted(r.name for r in snapshots.cards_as_of(spark, folder, day).collect()) == want


def test_filters_on_other_columns_are_spark_s(spark, folder):
    cards = snapshots.cards_as_of(spark, folder)
    assert [r.id for r in cards.where("year = 2001").collect()] == [3]
    assert [r.id for r in cards.where("set_name is null").collect()] == [4]
    assert cards.where("set_name = 'B' and set_name in ('A/1', 'C')").count() == 0
    assert cards.where("set_name = 'nowhere'").count() == 0


def test_search_takes_a_snapshot_and_opens_its_sets_only(spark, folder, tmp_path):
    snapshots.write_snapshot(snapshots.cards_as_of(spark, folder), str(tmp_path), "2024-03-01")
    (gear,) = glob.glob(f"{tmp_path}/day=2024-03-01/set_name=B/*.parquet")
    with open(gear, "wb") as f:
        f.write(b"broken")
    cards = snapshots.cards_as_of(spark, str(tmp_path))
    with pytest.raises(Exception, match="(?i)parquet"):
        cards.collect()
    asked = cards.where(F.col("set_name").isin("A/1", "C"))
    sets = spark.createDataFrame([("A/1", 1)], "set_name string, total int")
    query = spark.createDataFrame([(9, "Anvil Prime", 1, 1, 55, 2000)], "cid long, name string, num int, den int, hp int, year int")
    assert [(r.cid, r.id, r.route) for r in catalog.search(query, asked, sets).collect()] == [(9, 1, 1)]
