"""Refreshes by new days, and frozen items as intervals, against the full usage table."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import day, make_items, make_log, rows
from wearlog.operators import incremental, portfolio, tails, usage
from wearlog.plans import increments

START = day(1)
USAGE = "user category item date used active price cumuse cost_per_use days_active use_per_month plot_size".split()
ITEMS = "user string, category string, item string, price double, date_purchased date, date_divested date, used_init double"


def random_diary(spark, seed, days=60):
    """Two users; items with gaps, copies, unknown facts and unknown use; some stop, some come back."""
    random.seed(seed)
    log, items = [], []
    for user in ("u", "v"):
        for k in range(8):
            item, category = f"i{k}", random.choice(["Shirts", "Shoes", None])
            for _ in range(random.choice([1, 1, 1, 2])):
                bought = random.choice([None, START + dt.timedelta(random.randint(-30, days))])
                gone = random.choice([None, None, START + dt.timedelta(random.randint(1, days))])
                items.append((user, category, item, random.choice([None, 10.0, 40.0, 40.0]), bought, gone, random.choice([None, 0.0, 2.0])))
            stops, pauses = random.randint(5, days), random.randint(0, days)
            for n in range(stops):
                if not pauses < n < pauses + 20 and random.random() < 0.9:
                    log.append((user, category, item, START + dt.timedelta(n), random.choice([True, False, False, None] if k == 3 else [True, False])))
    return (
        spark.createDataFrame(log, "user string, category string, item string, date date, used boolean"),
        spark.createDataFrame(items, ITEMS),
        START + dt.timedelta(days - 1),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_refreshes_equal_a_full_run(spark, tmp_path, seed):
    log, items, last = random_diary(spark, seed)
    folder = str(tmp_path / "usage")
    for n in (10, 11, 35, 59):
        end = START + dt.timedelta(n)
        upto = log.where(F.col("date") <= end)  # later rows are not there yet
        increments.refresh(spark, folder, upto, items, START, end)
        full = usage.usage_table(upto, items, START, end, photos=False)
        assert rows(increments.usage(spark, folder), *USAGE) == rows(full, *USAGE)
    early = START + dt.timedelta(11)
    full = usage.usage_table(log.where(F.col("date") <= early), items, START, early, photos=False)
    assert rows(increments.usage(spark, folder, early), *USAGE) == rows(full, *USAGE)
    increments.refresh(spark, folder, log, items, START, last)  # nothing new
    assert len(increments.refreshed_days(spark, folder)) == 4
    with pytest.raises(ValueError):
        increments.refresh(spark, folder, log, items, START, early)
    increments.forget(spark, folder)
    assert increments.refreshed_days(spark, folder) == [last]


def test_a_broken_refresh_is_done_again(spark, tmp_path):
    log, items, last = random_diary(spark, 4)
    folder, half = str(tmp_path / "usage"), START + dt.timedelta(30)
    increments.refresh(spark, folder, log, items, START, half)
    log.limit(3).write.parquet(f"{folder}/days/upto={last}")  # days without a state
    assert increments.refreshed_days(spark, folder) == [half]
    increments.refresh(spark, folder, log, items, START, last)
    assert rows(increments.usage(spark, folder), *USAGE) == rows(usage.usage_table(log, items, START, last, photos=False), *USAGE)


def test_an_item_that_comes_back_leaves_no_carried_rows(spark, tmp_path):
    log = make_log(spark, [("a", day(1), True), ("a", day(9), True), ("b", day(9), False)])
    items = make_items(spark, [("a", 60.0, day(1), None, 0.0), ("b", 5.0, day(1), None, 0.0)])
    folder = str(tmp_path / "usage")
    increments.refresh(spark, folder, log, items, START, day(5))
    assert [r[0] for r in rows(increments.usage(spark, folder), "date")] == [day(n) for n in range(1, 6)]
    increments.refresh(spark, folder, log, items, START, day(9))
    assert rows(increments.usage(spark, folder), "item", "date", "cumuse") == [("a", day(1), 1.0), ("a", day(9), 2.0), ("b", day(9), 0.0)]


def test_a_refresh_reads_new_days_and_the_state_only(spark, tmp_path):
    log, items, last = random_diary(spark, 5)
    log.write.parquet(str(tmp_path / "log"))
    items.write.parquet(str(tmp_path / "items"))
    folder, half = str(tmp_path / "usage"), START + dt.timedelta(30)
    saved, listed = spark.read.parquet(str(tmp_path / "log")), spark.read.parquet(str(tmp_path / "items"))
    increments.refresh(spark, folder, saved, listed, START, half)
    state = increments._state(spark, folder, half)
    plan = incremental.new_days(saved.where(F.col("date") > half), listed, START, last, state)
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.split("\n") if "FileScan" in line]
    assert len(scans) == 3 and not any("/days" in line for line in scans)
    assert any("GreaterThan(date,2020-01-31)" in line for line in scans)
    assert len(re.findall("Exchange hashpartitioning", text)) <= 3


def test_changed_facts_need_a_rebuild(spark):
    log = make_log(spark, [(i, day(n), True) for i in "abcdefg" for n in (1, 4)])
    old = [(i, 10.0, day(1), None, 0.0) for i in "abcdefg"]
    items = make_items(spark, old)
    state = incremental.fold(incremental.new_days(log, items, START, day(4)))
    assert incremental.needs_rebuild(state, items, day(4)).count() == 0
    new = [
        ("a", 11.0, day(1), None, 0.0),
        ("b", 10.0, day(2), None, 0.0),
        ("c", 10.0, day(1), day(3), 0.0),
        ("d", 10.0, day(1), day(20), 0.0),  # divested later: nothing folded is touched
        ("e", 10.0, day(1), None, None),
        ("f", 10.0, day(1), None, 0.0),
        ("f", 10.0, day(1), None, 0.0),
        ("g", 10.0, day(1), None, 0.0),
        ("new", 1.0, day(5), None, 0.0),
    ]
    found = incremental.needs_rebuild(state, make_items(spark, new), day(4))
    assert [r[0] for r in rows(found, "item")] == ["a", "b", "c", "e", "f"]
    assert [r[0] for r in rows(incremental.needs_rebuild(state, make_items(spark, old[1:]), day(4)), "item")] == ["a"]


@pytest.mark.parametrize("seed", [6, 7])
def test_spans_and_their_reports(spark, seed):
    log, items, last = random_diary(spark, seed)
    use = usage.usage_table(log, items, START, last, photos=False)
    spans = tails.usage_spans(log, items, START, last)
    assert rows(tails.spread(spans, last), *USAGE) == rows(use, *USAGE)
    assert spans.count() < use.count()
    days = portfolio.category_days(use)
    assert rows(tails.category_days(spans, last), *days.columns) == rows(days, *days.columns)
    reports = portfolio.category_reports(use, window=7)
    assert rows(tails.category_reports(spans, last, window=7), *reports.columns) == rows(reports, *reports.columns)
    stock = portfolio.inventory(use, window=7)
    assert rows(tails.inventory(spans, last, window=7), *stock.columns) == rows(stock, *stock.columns)
    names = ["avg_use_per_month_divested", "avg_cost_per_use_divested"]
    averages = portfolio.divested_averages(use, min_days=5).where("not active and days_active >= 5")
    means = tails.divested_means(spans, last, min_days=5)
    rounded = [F.round(c, 9).alias(c) for c in names]
    keys = portfolio.KEYS
    assert rows(means.select(*keys, *rounded)) == rows(averages.select(*keys, *rounded).distinct())


def test_reports_shuffle_one_row_per_frozen_item(spark):
    log = make_log(spark, [(f"i{k}", day(1), True) for k in range(50)])
    items = make_items(spark, [(f"i{k}", 1.0, day(1), None, 0.0) for k in range(50)])
    end = day(1, 1, 2023)
    spans = tails.usage_spans(log, items, START, end)
    assert spans.count() == 100
    days = tails.category_days(spans, end)
    assert days.count() == 1097 and rows(days.where(F.col("date") == end), "itemcount", "cumuse", "category_value") == [(0, 50.0, 50.0)]


def test_empty_diary(spark, tmp_path):
    log, items = make_log(spark, []), make_items(spark, [])
    increments.refresh(spark, str(tmp_path / "usage"), log, items, START, day(5))
    assert increments.usage(spark, str(tmp_path / "usage")).count() == 0
    spans = tails.usage_spans(log, items, START, day(5))
    assert tails.category_reports(spans, day(5)).count() == 0 and tails.divested_means(spans, day(5)).count() == 0
