"""Versions of a table: what is written, what is read, and equality with whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import rows
from wearlog.operators import wear_rate
from wearlog.sources import storage, versions

SHAPE = "user string, category string, item string, date_purchased date, total_wears double"


@pytest.fixture()
def folder(spark):
    return storage.scratch_path(spark, "versions-test")


def study(spark, bought=("2019-03-01", "2020-05-01", "2020-06-01", "2021-01-01", None)):
    entries = [("u", "Shirts", f"i{k}", date, float(k)) for k, date in enumerate(bought)]
    return spark.createDataFrame(entries, SHAPE.replace(" date,", " string,")).withColumn("date_purchased", F.to_date("date_purchased"))


def periods_read(df):
    return {f"{f.split('in_version=')[1][0]}:{f.split('in_period=')[1].split('/')[0]}" for f in df.inputFiles()}


def test_only_changed_periods_are_written_and_read(spark, folder):
    first = study(spark)
    second = first.withColumn("total_wears", F.when(F.col("item") == "i1", 9.0).otherwise(F.col("total_wears")))
    year = versions.by_year("date_purchased")
    assert [versions.write_version(x, folder, year) for x in (first, second.repartition(3), second)] == [1, 2, 3]
    assert versions.versions(spark, folder) == [1, 2, 3]
    assert rows(versions.manifest(spark, folder, 3), "in_period", "n_rows", "in_version") == [
        ("2019", 1, 1), ("2020", 2, 2), ("2021", 1, 1), ("none", 1, 1),
    ]
    assert storage.subfolders(spark, f"{folder}/rows/in_version=2") == ["in_period=2020"]
    assert rows(versions.read_version(spark, folder, 1)) == rows(first)
    assert rows(versions.read_version(spark, folder, 3)) == rows(second)
    then, now = versions.read_changed(spark, folder, 1, 3)
    assert periods_read(then) == {"1:2020"} and periods_read(now) == {"2:2020"}
    assert rows(wear_rate.estimate_changes(now, then)) == rows(wear_rate.estimate_changes(second, first)) != []
    assert [x.count() for x in versions.read_changed(spark, folder, 2, 3)] == [0, 0]


def test_moved_added_and_removed_rows(spark, folder):
    first = study(spark)
    second = study(spark, ("2019-03-01", "2022-05-01", "2020-06-01")).withColumn("total_wears", F.col("total_wears") * 2)
    month = versions.by_month("date_purchased")
    for table in (first, second):
        versions.write_version(table, folder, month)
    then, now = versions.read_changed(spark, folder, 1, 2)
    assert rows(wear_rate.estimate_changes(now, then)) == rows(wear_rate.estimate_changes(second, first)) != []
    assert rows(versions.read_version(spark, folder, 2)) == rows(second)
    assert "1:2019-03" not in periods_read(then)


def test_odd_tables(spark, folder):
    spaced = spark.createDataFrame([("2020", None, "a"), ("2020", "a", None)], "`the year` string, x string, `y.z` string")
    swapped = spaced.select("the year", F.lit("a").alias("x"), F.lit(None).cast("string").alias("y.z"))
    year = F.col("the year")
    tables = [spaced, swapped, spaced.limit(0), spaced.union(spaced), spaced.withColumn("more", F.lit(1))]
    for k, table in enumerate(tables, 1):
        assert versions.write_version(table, folder, year) == k
        found = versions.read_version(spark, folder, k)
        assert found.columns == table.columns and sorted(map(str, found.collect())) == sorted(map(str, table.collect()))
        assert storage.exists(spark, f"{folder}/rows/in_version={k}") == (k != 3)
    with pytest.raises(ValueError):
        versions.write_version(spaced.withColumn("In_Period", F.lit(1)), folder, year)


def test_a_version_that_broke_off_is_not_seen(spark, folder):
    year = versions.by_year("date_purchased")
    versions.write_version(study(spark), folder, year)
    storage.save(study(spark).withColumn("in_period", F.lit("1999")), f"{folder}/rows/in_version=2", ["in_period"])
    assert versions.versions(spark, folder) == [1]
    later = study(spark, ("2019-03-02",))
    assert versions.write_version(later, folder, year) == 2
    assert rows(versions.read_version(spark, folder, 2)) == rows(later)
