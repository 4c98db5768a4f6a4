"""How much a task holds and how often sources are read, as tables grow."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from helpers import day
from registry import portfolio, relations, tables, usage
from wearlog.operators import daily_cost, listings, ordered
from wearlog.sources import storage, versions


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """600 order lines of 3 wardrobes, with repeated days."""
    folder = str(tmp_path_factory.mktemp("orders"))
    n = F.col("id").cast("int")
    storage.save(
        spark.range(200).select(
            F.col("id").alias("o_orderkey"), (F.col("id") % 300).alias("o_custkey"),
            F.date_add(F.lit(day(1, 1, 1995)), n * 12).cast("timestamp").alias("o_orderdate"),
            F.lit("O").alias("o_orderstatus"), F.lit("5-LOW").alias("o_orderpriority"),
        ),
        f"{folder}/orders.parquet",
    )
    storage.save(
        spark.range(10).select(
            F.col("id").alias("p_partkey"), F.element_at(F.array(*map(F.lit, tables.CATEGORIES)), n % 6 + 1).alias("p_type"),
            F.concat(F.lit("b"), F.col("id").cast("string")).alias("p_brand"), (n * 5 + 1).alias("p_size"),
        ),
        f"{folder}/part.parquet",
    )
    storage.save(
        spark.range(600).select(
            (F.col("id") % 200).alias("l_orderkey"), (F.col("id") * 7 % 10).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey"),
            (n % 7).alias("l_linenumber"), (n % 50).cast("double").alias("l_quantity"),
            F.when(n % 3 == 0, "R").otherwise("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
            F.lit(day(1, 1, 2001)).cast("timestamp").alias("l_shipdate"),
        ),
        f"{folder}/lineitem.parquet",
    )
    return folder


def test_parts_of_a_diary_follow_its_lines(spark, orders, monkeypatch):
    before = {tuple(r) for r in tables.use(spark, orders).drop("plot_size").collect()}
    monkeypatch.setattr(tables, "LINES_PER_PART", 50)
    assert tables.parts(spark, orders) == 13
    use = tables.use(spark, orders)
    placed = re.findall(r"hashpartitioning\(user#\d+, item#\d+, (\d+)\), (\w+)", plan(use))
    assert placed and set(placed) == {("13", "REPARTITION_BY_NUM")}  # no part is joined with another by its bytes
    assert {tuple(r) for r in use.drop("plot_size").collect()} == before


def test_lines_are_joined_in_parts_of_one_size(spark, orders, monkeypatch):
    monkeypatch.setattr(tables, "LINES_PER_PART", 5)
    placed = re.findall(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\), (\w+)", plan(tables.lines(spark, orders)))
    assert placed == [("12", "REPARTITION_BY_NUM")] * 2


def test_asof_costs_are_spread_and_averaged_without_a_shuffle_in_between(spark, orders):
    use = tables.saved_use(spark, orders)
    args = (use, portfolio.report_days(spark, orders))
    plain, cut = daily_cost.daily_cost_asof(*args, exclude=()), daily_cost.daily_cost_asof(*args, exclude=(), parts=5)
    top = plan(cut).split("Generate explode(_days")[0]
    assert "hashpartitioning" not in top and re.search(r"hashpartitioning\(user#\d+, 5\), REPARTITION_BY_NUM", plan(cut))
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_asof_costs_shuffle_one_row_per_item(spark, orders, monkeypatch):
    monkeypatch.setattr(tables, "LINES_PER_PART", 50)
    found = plan(portfolio.daily_cost_asof(spark, orders))
    top, below = re.split(r"Exchange hashpartitioning\(user#\d+, \d+\), REPARTITION_BY_NUM", found, maxsplit=1)
    assert "hashpartitioning" not in top and "explode(_used" in top  # used days meet changes behind the shuffle
    items = below.split("Window")[0]
    assert "collect_list(_used" in items and "collect_list(_change" in items
    assert "lineitem" in below  # the usage table is read in place, not written before


def test_asof_costs_of_odd_rows_are_those_of_the_days_before(spark):
    n = range(60)
    data = [
        (("u", "v", None)[i % 3], ("a", "b", "c", None)[i % 4], day(1 + i * 7 % 30) if i % 11 else None,
         None if i % 60 == 1 else float(1 + i * 13 % 17), i % 5 != 2, (True, None, True, False)[i // 3 % 4])
        for i in [*n, *n[:20]]
    ]
    use = spark.createDataFrame(data, "user string, item string, date date, cost_per_use double, active boolean, used boolean")
    reports = [day(5), day(12), day(12), None, day(13), day(26)]
    found = daily_cost.daily_cost_asof(
        use.withColumn("category", F.lit("Shirts")), spark.createDataFrame([(d,) for d in reports], "day date"), window=3
    )
    expected = []
    for report in filter(None, set(reports)):
        known = [r for r in data if None not in r[:3] and r[2] <= report]
        for user, date in {(r[0], r[2]) for r in known if r[5]}:
            worn = [[s for s in known if s[:2] == r[:2]] for r in known if r[0] == user and r[2] == date and r[5]]
            costs = [[s[3] for s in rows] for rows in worn]
            total = None if any(None in c for c in costs) else sum(map(min, costs))
            expected.append((user, report, date, total, any(all(s[4] for s in rows) for rows in worn)))
    rows = found.select("user", "day", "date", "daily_cost", "still_active").collect()
    assert len(expected) > 20 and sorted(map(tuple, rows), key=str) == sorted(expected, key=str)


def test_thinned_report_days_shuffle_no_rows(spark, orders):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the rows were many
    try:
        found = plan(portfolio.trimmed_days(spark, orders))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    result = found.split("BroadcastExchange")[0]
    assert "LeftSemi" in result and not re.search(r"hashpartitioning\((day|date)#", result)


def test_versions_are_written_from_a_saved_table(spark, orders, monkeypatch):
    seen, write = [], versions.write_version
    monkeypatch.setattr(versions, "write_version", lambda df, *a: seen.append(plan(df)) or write(df, *a))
    relations.changes_between_versions(spark, orders)
    assert len(seen) == 2 and not any("lineitem" in p for p in seen)


def test_refreshes_read_a_saved_log(spark, orders, monkeypatch):
    seen, refresh = [], usage.increments.refresh

    def recorded(spark, folder, log, items, *rest):
        seen.append(plan(log) + plan(items))
        refresh(spark, folder, log, items, *rest)

    monkeypatch.setattr(usage.increments, "refresh", recorded)
    usage.refreshed(spark, orders)
    assert len(seen) == 3 and not any("lineitem" in p for p in seen)


@pytest.mark.parametrize("query", [portfolio.times_used, portfolio.times_used_pooled])
def test_ranking_of_the_last_day_reads_a_saved_state(spark, orders, query):
    assert "lineitem" not in plan(query(spark, orders))


def test_ranking_of_all_dates_is_one_shuffle_of_the_item_days(spark, orders):
    found = plan(portfolio.times_used_all_dates(spark, orders))
    assert found.count("Exchange ") == 1 and "hashpartitioning(user" in found


@pytest.mark.parametrize("pooled", [False, True])
def test_ranking_in_pieces_gives_what_a_window_gives(spark, monkeypatch, pooled):
    days = [
        (u, c, f"item {i}", day(n), None if i == 3 else float(i * i + n), None if i == 5 else 40 - i % 4, i % 3 == 0 if i != 7 else None)
        for u, size in (("many", 12), (None, 9), ("few", 2))
        for c in ("Shirts", "Knits", None)
        for i in range(size)
        for n in range(1, 5)
    ]
    use = spark.createDataFrame(
        days, "user string, category string, item string, date date, cumuse double, days_active int, active boolean"
    )
    if pooled:  # one row for an item, so that no two rows tie
        use = use.withColumn("item", F.concat_ws("/", "category", "item"))
    args = {"last_only": False, "pooled": pooled}
    by_window = listings.times_used(use, **args)
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 30)
    in_pieces = listings.times_used(use, **args)
    assert "Union" in plan(in_pieces) and "Union" not in plan(by_window) and in_pieces.dtypes == by_window.dtypes
    digits = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    found = [sorted(map(digits, t.collect()), key=str) for t in (in_pieces, by_window)]
    assert found[0] == found[1] and len(found[0]) == len(days)
