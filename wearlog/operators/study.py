"""Wardrobe size, change and value in a multi-user study.

One aggregation each; all sums combine before the shuffle, so a user or category with
many items costs no more than a row per task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog.functions.numeric import as_int, count_if, loose_sum, ratio, rounded
from wearlog.functions.scalars import after, worn_at_least
from wearlog.operators.cleaning import Users, for_users

NOT_DIVESTED = "date_divested IS NULL"


def share_of(condition: Column) -> Column:
    """Share of rows on which a condition holds."""
    return count_if(condition) / F.count(F.lit(1))


def wardrobe_by_user(items: DataFrame) -> DataFrame:
    """Items not divested, share of them worn and their value, per user."""
    return items.where(NOT_DIVESTED).groupBy("user").agg(
        F.count(F.lit(1)).alias("items"),
        share_of(worn_at_least("wears")).alias("share_worn"),
        loose_sum("price").alias("value"),
    )


def wardrobe_by_category(
    items: DataFrame, exclude: Users | None = None, n_users: int | None = None
) -> DataFrame:
    """The same per category, with items per user and value per item.

    All users of the table count in the average, also those that ``exclude`` leaves out,
    unless their number is given.
    """
    users = F.lit(n_users) if n_users is not None else items.select(F.count_distinct("user")).scalar()
    return (
        for_users(items, exclude=exclude)
        .where(NOT_DIVESTED)
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("items"),
            share_of(worn_at_least("wears")).alias("share_worn"),
            loose_sum("price").alias("value"),
        )
        .withColumn("average_items", ratio("items", users))
        .withColumn("average_value", ratio("value", "items"))
    )


def wardrobe_by_user_category(items: DataFrame) -> DataFrame:
    return (
        items.where(NOT_DIVESTED)
        .groupBy("user", "category")
        .agg(F.count(F.lit(1)).alias("items"), loose_sum("price").alias("value"))
        .withColumn("average_value", ratio("value", "items"))
    )


def owned_at_start(items: DataFrame, start: dt.date) -> DataFrame:
    """Items bought by the start of the study, or at an unknown time."""
    return items.where((F.col("date_purchased") <= F.lit(start)) | F.col("date_purchased").isNull())


def start_matrix(items: DataFrame, start: dt.date, categories: Sequence[str]) -> DataFrame:
    """Items at the start of the study, user by category."""
    return crosstab(owned_at_start(items, start), "user", "category", categories)


def crosstab(
    items: DataFrame,
    row: str,
    column: str,
    values: Sequence[str],
    agg: Column | None = None,
    fill: float | None = None,
    unknown: str | None = None,
    other: str | None = None,
) -> DataFrame:
    """Matrix of a measure (rows by default), one column per listed value, in list order.

    Rows whose value is null or not in the list have columns of their own if ``unknown`` and
    ``other`` name them; otherwise such a row is an error, so that none is lost. Spark aggregates
    by row and column first, so only one value per cell is pivoted.
    """
    measure = F.count(F.lit(1)) if agg is None else agg
    values, extra = list(values), [x for x in (unknown, other) if x is not None]
    if set(extra) & set(values) or len(set(extra)) < len(extra):
        raise ValueError(f"{extra} and the listed values must differ")
    value = F.col(column).cast("string")

    def remainder(name: str | None) -> Column:
        missing = F.concat(F.lit(f"{column} is not listed: "), F.coalesce(value, F.lit("null")))
        return F.raise_error(missing).cast("string") if name is None else F.lit(name)

    label = F.when(value.isNull(), remainder(unknown)).when(value.isin(*values), value).otherwise(remainder(other))
    placed = items.withColumn("_column", label)
    table = placed.groupBy(row).pivot("_column", [*values, *extra]).agg(measure)
    return table if fill is None else table.fillna(fill, subset=[*values, *extra])


def _changes(items: DataFrame, keys: Sequence[str], start: dt.date) -> DataFrame:
    new, divested, price = after("date_purchased", start), after("date_divested", start), F.col("price")
    n, value = F.count(F.lit(1)), loose_sum("price")
    new_value, divested_value = loose_sum(F.when(new, price)), loose_sum(F.when(divested, price))
    return items.groupBy(*keys).agg(
        (n - count_if(new)).alias("items_at_start"),
        (n - count_if(divested)).alias("items_at_end"),
        count_if(new).alias("new_items"),
        count_if(divested).alias("divested_items"),
        rounded(value - new_value).alias("value_at_start"),
        rounded(new_value).alias("value_new_items"),
        rounded(divested_value).alias("value_divested_items"),
        rounded(value - divested_value).alias("value_at_end"),
    )


def change_by_user_category(items: DataFrame, start: dt.date) -> DataFrame:
    """Items and values at the start, new, divested and at the end of the study."""
    return _changes(items, ["user", "category"], start)


def change_by_user(items: DataFrame, start: dt.date) -> DataFrame:
    """The same per user, with shares of the wardrobe at the start."""
    change = F.col("new_items") - F.col("divested_items")
    return (
        _changes(items, ["user"], start)
        .withColumn("change", change)
        .withColumn("change_percent", rounded(ratio(change, "items_at_start"), 2))
        .withColumn("share_new", rounded(ratio("new_items", "items_at_start"), 2))
        .withColumn("share_divested", rounded(ratio("divested_items", "items_at_start"), 2))
    )


def _against_mean(table: DataFrame, column: str) -> Column:
    """Relative distance from the mean over all rows, two digits."""
    mean = table.select(F.avg(column)).scalar()
    return rounded(ratio(F.col(column) - mean, mean), 2)


def key_metrics(items: DataFrame) -> DataFrame:
    """Items, value and mean item value per user, each beside the mean over users.

    The means are one-row subqueries over the grouped table, not a window over all users.
    """
    table = (
        items.where(NOT_DIVESTED)
        .groupBy("user")
        .agg(F.count(F.lit(1)).alias("items"), rounded(loose_sum("price")).alias("value"))
        .withColumn("avg_item_value", rounded(ratio("value", "items"), 2))
    )
    return table.select(
        "user",
        "items",
        _against_mean(table, "items").alias("items_delta"),
        "value",
        _against_mean(table, "value").alias("value_delta"),
        "avg_item_value",
        _against_mean(table, "avg_item_value").alias("avg_item_value_delta"),
    )


def net_change(changes: DataFrame) -> DataFrame:
    """Net change in items and value per user, from the change table."""
    value_change = F.col("value_at_end") - F.col("value_at_start")
    return changes.select(
        "user",
        (F.col("new_items") - F.col("divested_items")).alias("net_new_items"),
        F.col("change_percent").alias("items_change"),
        value_change.alias("value_change"),
        rounded(ratio(value_change, "value_at_start"), 2).alias("value_change_percent"),
    )


def wardrobe_metrics(items: DataFrame, start: dt.date) -> DataFrame:
    """Key metrics beside net change, for users that have both."""
    return key_metrics(items).join(net_change(change_by_user(items, start)), "user")


def mean_metrics(items: DataFrame, start: dt.date) -> DataFrame:
    """Means over users of item value, change in items and change in value."""
    values = key_metrics(items).select(F.avg("avg_item_value")).scalar()
    return net_change(change_by_user(items, start)).agg(
        F.avg("items_change").alias("mean_items_change"), F.avg("value_change").alias("mean_value_change")
    ).withColumn("mean_item_value", values)


def price_variation(items: DataFrame) -> DataFrame:
    """Spread of item prices per category."""
    return (
        items.where(NOT_DIVESTED)
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("items"),
            loose_sum("price").alias("value"),
            F.avg("price").alias("mean"),
            F.stddev_samp("price").alias("sd"),
        )
        .withColumn("coefficient_of_variation", ratio("sd", "mean"))
    )


def average_stock(items: DataFrame, start: dt.date) -> DataFrame:
    """Mean of the stock at the end and at the start, in items and in value."""
    at_end = F.col("date_divested").isNull()
    at_start = F.coalesce(F.col("date_purchased") <= F.lit(start), F.lit(True))
    price = F.col("price")
    return items.agg(
        rounded((count_if(at_end) + count_if(at_start)) / F.lit(2.0)).alias("total_items"),
        rounded(
            (loose_sum(F.when(at_end, price)) + loose_sum(F.when(at_start, price))) / F.lit(2.0)
        ).alias("total_value"),
    )


def new_value_share(items: DataFrame, start: dt.date) -> DataFrame:
    """Value bought in the study as a share of all value, and its inverse in periods."""
    new = loose_sum(F.when(after("date_purchased", start), F.col("price")))
    return items.agg(new.alias("new_value"), loose_sum("price").alias("total_value")).select(
        ratio("new_value", "total_value").alias("new_share"), ratio("total_value", "new_value").alias("years_to_renew")
    )


def short_lived(items: DataFrame, start: dt.date) -> DataFrame:
    """Items bought since the start and divested, with their days in use."""
    return items.where((F.col("date_purchased") >= F.lit(start)) & F.col("date_divested").isNotNull()).withColumn(
        "days_in_use", F.datediff("date_divested", "date_purchased")
    )


def valuable_items(
    items: DataFrame, min_price: float, categories: Sequence[str] | None = None, above: bool = False
) -> DataFrame:
    """Items from a price on (or strictly above it), dearest first."""
    price = F.col("price")
    found = items.where(price > min_price if above else price >= min_price)
    if categories is not None:
        found = found.where(F.col("category").isin(*categories))
    return found.select("user", "category", "item", "price").orderBy(price.desc(), "user", "category", "item")


def largest_wardrobes(items: DataFrame) -> DataFrame:
    """The user with most items and the one with most value; ties go to the first by name."""
    sizes = items.groupBy("user").agg(F.count(F.lit(1)).alias("items"), loose_sum("price").alias("value"))

    def first(measure: str) -> DataFrame:
        return sizes.orderBy(F.col(measure).desc(), "user").limit(1).select(F.lit(measure).alias("largest_by"), "user", "items", "value")

    return first("items").union(first("value"))


def start_value_matrix(items: DataFrame, start: dt.date, categories: Sequence[str]) -> DataFrame:
    """Value at the start of the study, user by category."""
    return crosstab(owned_at_start(items, start), "user", "category", categories, loose_sum("price"))


def totals(items: DataFrame) -> DataFrame:
    """Size of the study in one row."""
    return items.agg(
        F.count(F.lit(1)).alias("items"),
        loose_sum("price").alias("value"),
        count_if(F.col("price").isNull()).alias("unknown_prices"),
        F.count_distinct("user").alias("users"),
        count_if(F.col("date_divested").isNotNull()).alias("divested_items"),
    )


def gender_totals(users: DataFrame) -> DataFrame:
    """Users per gender and their share."""
    n = users.select(F.count(F.lit(1))).scalar()
    return users.groupBy("gender").agg(F.count(F.lit(1)).alias("users")).withColumn("share", ratio("users", n))


def sentimental_share(items: DataFrame) -> DataFrame:
    """Share of items with sentimental value per user."""
    return (
        items.groupBy("user")
        .agg(F.count(F.lit(1)).alias("items"), loose_sum(as_int("sentimental_value")).alias("sentimental"))
        .withColumn("share_sentimental", rounded(ratio("sentimental", "items"), 2))
    )
