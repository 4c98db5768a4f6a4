"""Wears per month as estimated before the study and as logged in it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog import defaults
from wearlog.functions.numeric import overflows, ratio, rounded
from wearlog.functions.scalars import calendar_months
from wearlog.operators.joins import join_null_safe
from wearlog.operators.ordered import gini
from wearlog.operators.study import crosstab

KEYS = ["user", "category"]
ONE_WEAR = 0.1  # wears per month that a single wear in a year rounds to


def _exact_sum(column: str) -> Column:
    """Sum of one-digit numbers that does not depend on their order."""
    return F.sum(F.col(column).cast("decimal(38,1)")).cast("double")


def wpm_items(items: DataFrame, start: dt.date, months_tracked: int = 12) -> DataFrame:
    """Estimated and logged wears per month of items owned before the study."""
    return (
        items.where(F.col("total_wears").isNotNull())
        .withColumn("months_available", calendar_months("date_purchased", start))
        .where(F.col("months_available") > 0)
        .select(
            "user",
            "category",
            "item",
            "months_available",
            F.col("wears").alias("wears_real"),
            F.col("total_wears").alias("wears_est"),
            rounded(ratio("total_wears", "months_available"), 1).alias("wpm_est"),
            rounded(F.col("wears") / F.lit(float(months_tracked)), 1).alias("wpm_real"),
            F.col("date_divested").isNotNull().alias("divested"),
        )
        .withColumn(
            "wpm_delta",
            F.when(overflows("wpm_est", "wpm_real"), rounded(F.col("wpm_est") / F.lit(ONE_WEAR), 1)).otherwise(
                rounded(ratio("wpm_est", "wpm_real"), 1)
            ),
        )
    )


def wpm_category(per_item: DataFrame, on_zero: str = "estimate", digits: int = 1) -> DataFrame:
    """Estimated and logged wears per month per user and category.

    Without any logged wear the ratio is taken to one wear (``on_zero='estimate'``) or
    left unknown (``'null'``).
    """
    if on_zero not in ("estimate", "null"):
        raise ValueError(f"unknown rule {on_zero!r}")
    delta = rounded(ratio("est", "real"), digits)
    if on_zero == "estimate":
        delta = F.when(overflows("est", "real"), rounded(F.col("est") / F.lit(ONE_WEAR), 1)).otherwise(delta)
    return (
        per_item.groupBy(*KEYS)
        .agg(
            F.sum("wears_real").alias("wears_real"),
            _exact_sum("wpm_est").alias("est"),
            _exact_sum("wpm_real").alias("real"),
        )
        .withColumn("delta_to_real", delta)
        .withColumn("delta_to_max", rounded(F.col("est") / F.lit(defaults.DAYS_PER_MONTH), digits))
    )


def wpm_means(per_item: DataFrame, per_category: DataFrame, months_tracked: int = 12) -> DataFrame:
    """Means over users of logged wears per month and of the ratio to the estimate."""
    real = (
        per_item.groupBy(*KEYS)
        .agg((F.sum("wears_real") / F.lit(float(months_tracked))).alias("wpm_real"))
        .groupBy("category")
        .agg(F.avg("wpm_real").alias("avg_wpm_real"))
    )
    delta = per_category.groupBy("category").agg(F.avg("delta_to_real").alias("avg_delta_to_real"))
    return join_null_safe(real, delta, ["category"])


def wpm_matrix(per_category: DataFrame, measure: str, categories: Sequence[str]) -> DataFrame:
    """User by category matrix of ``real``, ``delta_to_max`` or ``delta_to_real``."""
    return crosstab(per_category, "user", "category", categories, F.first(measure))


def category_wears(items: DataFrame) -> DataFrame:
    """Wears of each user and category, the unused potential, and how uneven wears are.

    The distance of all items from the most worn one is n times the maximum less the sum,
    so no row needs to meet the maximum of its group.
    """
    rows = items.where(F.col("total_wears").isNotNull())
    n, total, most = F.count(F.lit(1)), F.sum("wears"), F.max("wears")
    summary = rows.groupBy(*KEYS).agg(
        total.alias("total_wears"),
        n.alias("items"),
        most.alias("max_wears"),
        (n * most - total).alias("category_potential"),
    )
    return (
        join_null_safe(summary, gini(rows, KEYS, "wears", digits=2), KEYS, "left")
        .withColumn("avg_wears", rounded(ratio("total_wears", "items")))
        .withColumn("supply_in_years", rounded(ratio("category_potential", "total_wears"), 1))
    )


def wear_gini(items: DataFrame, unbiased: bool = False) -> DataFrame:
    """Concentration of wears per user and category."""
    return gini(items, KEYS, "wears", unbiased)


def category_wpm(wears: DataFrame, categories: Sequence[str], months_tracked: int = 12) -> DataFrame:
    """Wears per month of whole categories, user by category."""
    rates = wears.withColumn("category_wpm", rounded(F.col("total_wears") / F.lit(float(months_tracked)), 1))
    return crosstab(rates, "user", "category", categories, F.first("category_wpm"))


def mean_category_wpm(wears: DataFrame, months_tracked: int = 12) -> DataFrame:
    """Mean over users of the category rate: the column means of the matrix."""
    rate = rounded(F.col("total_wears") / F.lit(float(months_tracked)), 1).cast("decimal(38,1)")
    return wears.groupBy("category").agg(F.avg(rate).cast("double").alias("mean_category_wpm"))


def mean_category_wears(wears: DataFrame) -> DataFrame:
    """Means over users of the category measures."""
    supply = F.avg(F.col("supply_in_years").cast("decimal(38,1)")).cast("double")
    return wears.groupBy("category").agg(
        rounded(F.avg("total_wears")).alias("avg_total_wears"),
        rounded(F.avg("avg_wears")).alias("avg_wears"),
        rounded(F.avg("max_wears")).alias("avg_max_wears"),
        rounded(F.avg("category_potential")).alias("avg_category_potential"),
        rounded(supply, 1).alias("avg_supply_in_years"),
    )


def estimate_changes(current: DataFrame, original: DataFrame) -> DataFrame:
    """Items whose estimated earlier wears differ between two snapshots."""
    keys = ["user", "category", "item"]
    now = current.select(*keys, "date_purchased", "total_wears")
    then = original.select(*keys, F.col("total_wears").alias("total_wears_orig"))
    change = F.col("total_wears") - F.col("total_wears_orig")
    return join_null_safe(now, then, keys).withColumn("wears_change", change).where(F.col("wears_change") != 0)
