"""Cost per wear, wear segments, washes, and the age at which items leave."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearlog.functions.numeric import count_if, loose_sum, overflows, ratio, rounded
from wearlog.functions.scalars import effective_wears
from wearlog.operators.ordered import with_group_median
from wearlog.operators.study import crosstab

# Lowest and highest wears of the report segments; an open end is None.
SEGMENTS = {"0_4": (0, 4), "5_50": (5, 50), "51_up": (51, None)}


def cpw_total(items: DataFrame) -> DataFrame:
    """Items with a cost per wear, against all wears including those before the diary."""
    return items.select(
        "user", "category", "item", "cpw", (F.col("total_wears") + F.col("wears")).alias("plot_wears")
    ).where(F.col("cpw") > 0)


def cpw_diary(items: DataFrame) -> DataFrame:
    """Cost per diary wear; unworn items cost their price, free items are left out."""
    return items.select(
        "user",
        "category",
        "item",
        ratio("price", effective_wears("wears")).alias("cpw"),
        F.col("wears").alias("plot_wears"),
        "price",
        "secondhand",
    ).where(F.col("cpw") > 0)


def wear_segments(
    diary: DataFrame, bounds: Mapping[str, tuple[float, float | None]] = SEGMENTS, by: Sequence[str] = ("category",)
) -> DataFrame:
    """Share of items and of value per wear segment, from diary costs per wear."""
    wears = F.col("plot_wears")
    sums, shares = [], []
    for name, (low, high) in bounds.items():
        inside = wears >= low if high is None else (wears >= low) & (wears <= high)
        sums += [
            count_if(inside).alias(f"_n_{name}"),
            loose_sum(F.when(inside, F.col("price"))).alias(f"_v_{name}"),
        ]
        shares += [
            rounded(ratio(f"_n_{name}", "items"), 2).alias(f"share_items_{name}"),
            rounded(ratio(f"_v_{name}", "value"), 2).alias(f"share_value_{name}"),
        ]
    return (
        diary.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("items"), loose_sum("price").alias("value"), *sums)
        .select(*by, "items", "value", *shares)
    )


def cpw_summary(diary: DataFrame) -> DataFrame:
    """Items, value, mean wears, mean and median cost per wear, per category."""
    summary = diary.groupBy("category").agg(
        F.count(F.lit(1)).alias("items"),
        rounded(F.sum("price"), 2).alias("value"),
        rounded(F.avg("plot_wears")).alias("wears_mean"),
        rounded(F.avg("cpw"), 2).alias("cpw_mean"),
    )
    return with_group_median(summary, diary, ["category"], {"cpw_median": "cpw"}).withColumn(
        "cpw_median", rounded("cpw_median", 2)
    )


def wears_per_wash(items: DataFrame) -> DataFrame:
    """Wears per wash of each item: its wears if never washed, unknown if never worn either."""
    return items.select(
        "user",
        "category",
        "item",
        F.when(overflows("wears", "washed"), F.col("wears"))
        .otherwise(rounded(ratio("wears", "washed"), 1))
        .alias("wears_per_wash"),
    )


def mean_wears_per_wash(per_item: DataFrame) -> DataFrame:
    # Summed as decimals: the addends have one digit, so the mean does not depend on their order.
    exact = F.avg(F.col("wears_per_wash").cast("decimal(38,1)")).cast("double")
    return per_item.groupBy("user", "category").agg(rounded(exact, 1).alias("wears_per_wash"))


def wears_per_wash_matrix(items: DataFrame, categories: Sequence[str]) -> DataFrame:
    means = mean_wears_per_wash(wears_per_wash(items))
    return crosstab(means, "user", "category", categories, F.first("wears_per_wash"))


def divested_age(items: DataFrame, start: dt.date) -> DataFrame:
    """Years in the wardrobe of the items divested in the study."""
    days = F.datediff("date_divested", "date_purchased")
    return items.where(F.col("date_divested") > F.lit(start)).select(
        "user",
        "category",
        "item",
        "price",
        "wears",
        "cpw",
        rounded(days / F.lit(365.0), 1).alias("wardrobe_age"),
        "divestment_way",
        "condition",
    )


def mean_divested_age(divested: DataFrame) -> DataFrame:
    exact = F.avg(F.col("wardrobe_age").cast("decimal(38,1)")).cast("double")
    return divested.groupBy("category").agg(
        F.count(F.lit(1)).alias("items"), rounded(exact, 1).alias("avg_wardrobe_age_years")
    )
