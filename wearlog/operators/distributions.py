"""Distributions of wears, prices and ages."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog import defaults
from wearlog.functions import scalars
from wearlog.functions.numeric import capped, count_if, ratio, rounded
from wearlog.operators.ordered import exact_quantiles, row_positions, with_group_median
from wearlog.operators.study import NOT_DIVESTED, share_of


def share_worn(items: DataFrame, n: int = 1, below: bool = False, active_only: bool = True) -> DataFrame:
    """Items per user and category and the share worn at least (or less than) n times."""
    rows = items.where(NOT_DIVESTED) if active_only else items
    met = F.col("wears") < n if below else F.col("wears") >= n
    return rows.groupBy("user", "category").agg(
        F.count(F.lit(1)).alias("items"), share_of(met).alias("share_worn")
    )


def rarely_worn(
    items: DataFrame, n: int = 4, exclude: Sequence[str] = defaults.RARELY_WORN_EXCLUDED_CATEGORIES
) -> DataFrame:
    """Share of items never worn and worn less than n times, per user."""
    table = (
        items.where(F.coalesce(~F.col("category").isin(*exclude), F.lit(True)))
        .groupBy("user")
        .agg(
            F.count(F.lit(1)).alias("items"),
            count_if(F.col("wears") >= 1).alias("worn_1"),
            count_if(F.col("wears") >= n).alias("worn_n"),
        )
    )
    return table.withColumn("share_unworn", rounded(1 - ratio("worn_1", "items"), 2)).withColumn(
        "share_rarely_worn", rounded(1 - ratio("worn_n", "items"), 2)
    )


def rarely_worn_overall(by_user: DataFrame) -> DataFrame:
    """The same over all users, weighted by their items."""
    return by_user.agg(
        F.sum("items").alias("items"), F.sum("worn_1").alias("worn_1"), F.sum("worn_n").alias("worn_n")
    ).select(
        (1 - ratio("worn_1", "items")).alias("share_unworn"),
        (1 - ratio("worn_n", "items")).alias("share_rarely_worn"),
    )


def tier_shares(
    rows: DataFrame, keys: Sequence[str], label: Column, tiers: scalars.Tiers, top: tuple[float, str]
) -> DataFrame:
    """Items per tier with share and running share over the tiers that occur.

    The windows see one row per tier.
    """
    keys = list(keys)
    group = W.partitionBy(*keys)
    so_far = group.orderBy("tier_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    all_items = F.sum("items").over(group)
    return (
        rows.withColumn("tier", label)
        .where(F.col("tier").isNotNull())
        .groupBy(*keys, "tier")
        .agg(F.count(F.lit(1)).alias("items"))
        .withColumn("tier_rank", scalars.tier_rank("tier", tiers, top))
        .withColumn("cum_items", F.sum("items").over(so_far))
        .withColumn("share", ratio("items", all_items))
        .withColumn("cum_share", ratio("cum_items", all_items))
    )


def wear_tiers(items: DataFrame) -> DataFrame:
    """Diary wears in tiers per category."""
    return tier_shares(
        items, ["category"], scalars.wear_tier("wears"), scalars.WEAR_TIERS, scalars.WEAR_TIER_TOP
    )


def wear_tier_matrix(items: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Items per wear tier and category."""
    table = wear_tiers(items)
    return table.groupBy("tier_rank", "tier").pivot("category", list(categories)).agg(F.first("items"))


def age_tiers(items: DataFrame, asof: dt.date, by_user: bool = False, compat: bool = True) -> DataFrame:
    """Years in the wardrobe in tiers, for items not divested."""
    keys = ["user", "category"] if by_user else ["category"]
    label = scalars.age_tier(scalars.age_years("date_purchased", asof), compat)
    tiers = scalars.AGE_TIERS if compat else (*scalars.AGE_TIERS, (10, "10"))
    return tier_shares(items.where(NOT_DIVESTED), keys, label, tiers, scalars.AGE_TIER_TOP)


def wears_price_by_age(items: DataFrame, asof: dt.date) -> DataFrame:
    """Wears and price of each item with its age band."""
    days = F.datediff(F.lit(asof), "date_purchased")
    return items.select("user", "category", "item", "wears", "price", scalars.age_band(days).alias("age_band"))


def histogram(
    df: DataFrame,
    column: str,
    width: float,
    maximum: float | None = None,
    by: Sequence[str] = ("category",),
    centred: bool = False,
) -> DataFrame:
    """Counts in bins of equal width, closed on the right; values out of range do not count.

    Bins start at 0, or with ``centred`` have their middle at the multiples of the width.
    """
    x = F.col(column)
    rows = df.where(x >= 0) if maximum is None else df.where((x >= 0) & (x <= maximum))
    steps = x / F.lit(float(width))
    if centred:
        number, low = F.ceil(steps - 0.5), F.lit(-0.5)
    else:
        number, low = F.greatest(F.ceil(steps) - 1, F.lit(0)), F.lit(0.0)
    return (
        rows.groupBy(*by, number.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("items"))
        .withColumn("bin_from", (F.col("bin") + low) * width)
        .withColumn("bin_to", (F.col("bin") + low + 1) * width)
    )


def category_stats(df: DataFrame, column: str, by: Sequence[str] = ("category",)) -> DataFrame:
    """Count, mean, median and maximum of a measure per category."""
    by = list(by)
    summary = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.avg(column).alias("mean"), F.max(column).alias("max")
    )
    return with_group_median(summary, df, by, {"median": column})


def ranked_items(items: DataFrame, column: str = "wears", cap: float = defaults.PRICE_AND_WEAR_CEILING) -> DataFrame:
    """Items numbered from the highest value down within user and category; unknown values last."""
    rows = items.select("user", "category", "item", column)
    order = [F.desc_nulls_last(column), F.col("item").asc()]
    return row_positions(rows, ["user", "category"], order, "index").withColumn(column, capped(column, cap))


def share_above(items: DataFrame, n: float = 120, few: float = 5) -> DataFrame:
    """Share of items with more than n wears and number with at most ``few``, per category."""
    return items.groupBy("category").agg(
        share_of(F.col("wears") > n).alias("share_above"),
        count_if(F.col("wears") <= few).alias("few_wears"),
    )


def wear_quantile(items: DataFrame, p: float = 0.5) -> DataFrame:
    """Exact quantile of wears per category."""
    return exact_quantiles(items, ["category"], "wears", {"quantile": p})


def top(df: DataFrame, by: str, n: int, largest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The n rows with the highest (or lowest) value; unknown values never come first."""
    order = F.desc_nulls_last(by) if largest else F.asc_nulls_last(by)
    return df.orderBy(order, *ties).limit(n)


def top_groups(items: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The n largest groups by number of items."""
    return top(items.groupBy(*keys).agg(F.count(F.lit(1)).alias("items")), "items", n, ties=keys)

