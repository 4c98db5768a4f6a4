"""What Spark makes of the operators: one shuffle where one is enough, and pruned scans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from helpers import day
from wearlog.operators import daily_cost, portfolio, usage
from wearlog.operators.distributions import wear_tiers
from wearlog.operators.study import wardrobe_by_user
from wearlog.sources import storage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange (?:hashpartitioning|SinglePartition|rangepartitioning)\(?[^)]*", plan(df))


@pytest.fixture(scope="module")
def tables(spark):
    """A log and an item list on disk, without broadcast joins, as if both were large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    days = spark.range(60).select(F.date_add(F.lit(day(1)), F.col("id").cast("int")).alias("date"))
    owners = spark.range(40).select(
        (F.col("id") % 4).cast("string").alias("user"), F.lit("Shirts").alias("category"), F.col("id").cast("string").alias("item")
    )
    log = owners.join(days, F.lit(True)).withColumn("used", F.dayofmonth("date") % 3 == 0)
    items = owners.select(
        "*", F.lit(10.0).alias("price"), F.lit(day(1)).alias("date_purchased"), F.lit(None).cast("date").alias("date_divested"),
        F.lit(0.0).alias("used_init"), F.lit("p").alias("photo"), F.lit("cotton").alias("materials"),
    )
    yield storage.materialised(log, "log"), storage.materialised(items, "items")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_usage_table_shuffles_log_and_items_once(tables):
    log, items = tables
    use = usage.usage_table(log, items, day(1), day(28, 2))
    assert len(exchanges(use)) == 2 and all("user" in e and "item" in e for e in exchanges(use))
    assert "materials" not in plan(use)


def test_last_state_generates_and_sorts_no_days(tables):
    log, items = tables
    text = plan(usage.last_state(log, items, day(1), day(28, 2)))
    assert "Generate" not in text and "Window" not in text and "partial_max_by" in text


def test_portfolio_adds_partial_sums_before_its_shuffles(tables):
    log, items = tables
    use = storage.materialised(usage.usage_table(log, items, day(1), day(28, 2)), "use")
    stock = portfolio.inventory(use, one_row_per_day=True)
    assert len(exchanges(stock)) == 2 and "partial_" in plan(stock)
    for unused in ("photo", "plot_size", "days_active"):
        assert unused not in plan(stock)
    assert len(exchanges(portfolio.use_to_date(use))) == 2
    assert len(exchanges(portfolio.category_reports(use, one_row_per_day=True))) == 2


def test_daily_cost_shuffles_only_used_rows(tables):
    log, items = tables
    use = storage.materialised(usage.usage_table(log, items, day(1), day(28, 2)), "use")
    text = plan(daily_cost.daily_cost(use))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(used,true\)", text)
    assert "partial_min(cost_per_use" in text


def test_filters_and_columns_reach_the_scan(spark):
    study = spark.range(100).select(
        F.lit("u").alias("user"), F.lit("c").alias("category"), F.col("id").cast("string").alias("item"),
        F.col("id").cast("double").alias("wears"), F.lit(1.0).alias("price"), F.lit(None).cast("date").alias("date_divested"),
    )
    saved = storage.materialised(study, "study")
    text = plan(wardrobe_by_user(saved))
    assert "PushedFilters: [IsNull(date_divested)]" in text
    assert "ReadSchema: struct<user:string,wears:double,price:double,date_divested:date>" in text
    assert "ReadSchema: struct<category:string,wears:double>" in plan(wear_tiers(saved))
