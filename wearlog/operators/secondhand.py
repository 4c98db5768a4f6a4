"""Secondhand items: shares before and during the study, and how they compare to new ones."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog import defaults
from wearlog.functions.numeric import as_int, count_if, loose_sum, ratio, rounded, strict_sum, strict_sum_if
from wearlog.functions.scalars import after


def _old_and_new(items: DataFrame, start: dt.date, whole: str | None, part: Column, names: tuple[str, str]) -> DataFrame:
    """Part and whole among items owned before and bought in the study, side by side."""
    new = after("date_purchased", start)
    columns = []
    for prefix, group in (("old", ~new), ("new", new)):
        n = count_if(group)
        size = F.when(n > 0, n) if whole is None else F.when(n > 0, strict_sum_if(whole, group))
        columns += [size.alias(f"{prefix}_{names[0]}"), strict_sum_if(part, group).alias(f"{prefix}_{names[1]}")]
    table = items.where(F.col("date_purchased").isNotNull()).groupBy("user").agg(*columns)
    for prefix in ("old", "new"):
        share = rounded(ratio(f"{prefix}_{names[1]}", f"{prefix}_{names[0]}"), 2)
        table = table.withColumn(f"{prefix}_share", share)
    return table.withColumn("share_change", F.col("new_share") - F.col("old_share"))


def secondhand_share(items: DataFrame, start: dt.date) -> DataFrame:
    """Share of secondhand items per user, owned before and bought in the study."""
    return _old_and_new(items, start, None, as_int("secondhand"), ("items", "secondhand_items"))


def _secondhand_value() -> Column:
    return as_int("secondhand") * F.col("price")


def secondhand_value_share(items: DataFrame, start: dt.date) -> DataFrame:
    """The same by value; items without a price or origin are left out."""
    valued = items.where(_secondhand_value().isNotNull())
    return _old_and_new(valued, start, "price", _secondhand_value(), ("value", "secondhand_value"))


def secondhand_end(items: DataFrame) -> DataFrame:
    """Secondhand items and value per user at the end of the study."""
    return (
        items.where(_secondhand_value().isNotNull() & F.col("date_divested").isNull())
        .groupBy("user")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum(as_int("secondhand")).alias("secondhand_items"),
            F.sum("price").alias("value"),
            F.sum(_secondhand_value()).alias("secondhand_value"),
        )
        .withColumn("secondhand_share", rounded(ratio("secondhand_value", "value"), 2))
    )


def secondhand_items(items: DataFrame) -> DataFrame:
    return items.where("secondhand").select("user", "category", "item", "price", "secondhand_type", "secondhand")


def users_with_secondhand(items: DataFrame) -> DataFrame:
    """Number of users with a secondhand item, and of such items."""
    return items.where("secondhand").agg(
        F.count_distinct("user").alias("users"), F.count(F.lit(1)).alias("items")
    )


def secondhand_by_user(items: DataFrame) -> DataFrame:
    return (
        items.groupBy("user")
        .agg(
            F.count(F.lit(1)).alias("items"),
            rounded(loose_sum("price")).alias("value"),
            strict_sum(as_int("secondhand")).alias("secondhand"),
        )
        .withColumn("share", rounded(ratio("secondhand", "items"), 2))
    )


def secondhand_gap(items: DataFrame, measure: str, exclude: Sequence[str] = defaults.GAP_EXCLUDED_CATEGORIES) -> DataFrame:
    """Mean of a measure for used over new items per user and category that has both.

    Only priced items count; a ratio over zero is left out.
    """
    category = F.col("category")
    mean = {
        name: rounded(F.avg(F.when(F.col("secondhand") == used, F.col(measure))), 2).alias(name)
        for name, used in (("new", False), ("used", True))
    }
    return (
        items.where(F.coalesce(~category.isin(*exclude), F.lit(True)) & (F.col("price") > 0))
        .groupBy("user", "category")
        .agg(mean["new"], mean["used"])
        .where((F.col("used") > 0) & (F.col("new") > 0))
        .withColumn("gap", rounded(ratio("used", "new"), 2))
    )


def secondhand_price_gap(items: DataFrame) -> DataFrame:
    return secondhand_gap(items, "price")


def secondhand_wear_gap(items: DataFrame) -> DataFrame:
    return secondhand_gap(items, "wears")


def mean_gap(gaps: DataFrame) -> DataFrame:
    """Users and mean gap per category."""
    return gaps.groupBy("category").agg(
        F.count(F.lit(1)).alias("users"), rounded(F.avg("gap"), 2).alias("avg_gap")
    )


def secondhand_profile(diary: DataFrame) -> DataFrame:
    """Mean wears, price and cost per wear of new and used items, from diary costs per wear."""
    return diary.groupBy("category", "secondhand").agg(
        F.count(F.lit(1)).alias("items"),
        F.avg("plot_wears").alias("avg_wears"),
        F.avg("price").alias("avg_price"),
        F.avg("cpw").alias("avg_cpw"),
    )
