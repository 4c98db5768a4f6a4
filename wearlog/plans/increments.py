"""A usage table that is kept up to date by its new days.

Folder layout: ``days/upto=D`` has the log days that the refresh up to D added, ``state/upto=D`` the
state after it. The state is written last: days of a refresh that broke off are not seen, and are
written again by the next one. Each refresh reads the new log days, the items and the last state.
States of earlier refreshes stay until ``forget``, and are snapshots of all items for a day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearlog.operators import incremental
from wearlog.operators.tails import spread
from wearlog.sources import storage


def refreshed_days(spark: SparkSession, folder: str) -> list[dt.date]:
    """Days up to which the table was refreshed, from the names in the folder."""
    names = storage.subfolders(spark, f"{folder}/state")
    return sorted(dt.date.fromisoformat(n.removeprefix("upto=")) for n in names if n.startswith("upto="))


def _state(spark: SparkSession, folder: str, upto: dt.date) -> DataFrame:
    return storage.load(spark, f"{folder}/state/upto={upto}")


def refresh(spark: SparkSession, folder: str, log: DataFrame, items: DataFrame, start: dt.date, end: dt.date) -> None:
    """Add the log days up to ``end``. A second refresh up to the same day changes nothing."""
    done = refreshed_days(spark, folder)
    if done and end <= done[-1]:
        if end == done[-1]:
            return
        raise ValueError(f"the table has the days up to {done[-1]} already")
    before = _state(spark, folder, done[-1]) if done else None
    if done:
        log = log.where(F.col("date") > F.lit(done[-1]))
    path = f"{folder}/days/upto={end}"
    storage.save(incremental.new_days(log, items, start, end, before), path)
    storage.save(incremental.fold(storage.load(spark, path), before), f"{folder}/state/upto={end}")


def spans(spark: SparkSession, folder: str, end: dt.date | None = None) -> DataFrame:
    """Log days and frozen rests as of a refresh; the last one if no day is given."""
    done = refreshed_days(spark, folder)
    end = done[-1] if end is None else end
    if end not in done:
        raise ValueError(f"the table was not refreshed up to {end}")
    parts = [f"{folder}/days/upto={d}" for d in done if d <= end]
    days = spark.read.parquet(*parts).withColumn("tail", F.lit(False))
    rest = incremental.tails(_state(spark, folder, end), end)
    return days.unionByName(rest).drop(*incremental.SUMS)


def usage(spark: SparkSession, folder: str, end: dt.date | None = None) -> DataFrame:
    """The usage table as of a refresh, row for row that of a full run."""
    done = refreshed_days(spark, folder)
    return spread(spans(spark, folder, end), done[-1] if end is None else end)


def forget(spark: SparkSession, folder: str, keep: int = 1) -> None:
    """Delete all states but the last ones."""
    for day in refreshed_days(spark, folder)[:-keep]:
        storage.delete(spark, f"{folder}/state/upto={day}")
