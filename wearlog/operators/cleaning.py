"""Cleaning, reshaping and dimension joins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog import defaults
from wearlog.functions.numeric import rounded
from wearlog.functions.scalars import _date

Users = Sequence[str] | DataFrame


def clip_to_ownership(
    log: DataFrame, items: DataFrame, start: Column | dt.date, end: Column | dt.date
) -> DataFrame:
    """Keep the days on which an item was owned, both ends included.

    Copies of an item count from the latest purchase to the earliest divestment; unknown
    dates fall back to the range of the log.
    """
    start, end = _date(start), _date(end)
    owned = items.groupBy("user", "item").agg(
        F.greatest(F.max("date_purchased"), start).alias("_from"),
        F.least(F.min("date_divested"), end).alias("_to"),
    )
    day = F.col("date")
    return (
        log.join(owned, ["user", "item"], "left")
        .where((day >= F.coalesce("_from", start)) & (day <= F.coalesce("_to", end)))
        .select(*log.columns)
    )


def drop_placeholders(df: DataFrame, names: Sequence[str] = defaults.PLACEHOLDER_ITEMS) -> DataFrame:
    """Drop rows of placeholder items; unnamed items stay."""
    return df.where(~F.coalesce(F.col("item").isin(*names), F.lit(False)))


def with_category_rank(df: DataFrame, dim: DataFrame, column: str = "category") -> DataFrame:
    """Attach the report rank; a category that the dimension lacks becomes null."""
    known = dim.select(F.col("category").alias("_known"), "rank")
    return (
        df.drop("rank")
        .join(known, F.col(column) == F.col("_known"), "left")
        .withColumn(column, F.col("_known"))
        .drop("_known")
    )


def apply_category_changes(items: DataFrame, changes: DataFrame, dim: DataFrame) -> DataFrame:
    """Recategorise items; the last change wins and an unknown target gives null."""
    latest = (
        changes.groupBy("user", "item")
        .agg(F.max_by("target_category", "change_seq").alias("_target"))
        .transform(lambda d: with_category_rank(d, dim, "_target"))
        .select("user", "item", "_target", F.lit(True).alias("_changed"))
    )
    return (
        items.join(latest, ["user", "item"], "left")
        .withColumn("category", F.when(F.col("_changed"), F.col("_target")).otherwise(F.col("category")))
        .select(*items.columns)
    )


def clean_study(
    items: DataFrame,
    start: dt.date,
    text: str = defaults.DROPPED_STUDY_ITEMS[1],
    text_category: str = defaults.DROPPED_STUDY_ITEMS[0],
    dropped_category: str = defaults.DROPPED_STUDY_CATEGORY,
) -> DataFrame:
    """Row filters of the study: named accessories, one category, earlier divestments.

    Dropping a category by name also drops items without a category.
    """
    named = (F.col("category") == text_category) & F.col("item").contains(text)
    return items.where(
        ~named
        & (F.col("category") != dropped_category)
        & (F.col("date_divested").isNull() | (F.col("date_divested") >= F.lit(start)))
    )


def for_users(df: DataFrame, include: Users | None = None, exclude: Users | None = None) -> DataFrame:
    """Limit to or leave out users, named in a short list or in a table with a user column."""
    if include is not None:
        if isinstance(include, DataFrame):
            df = df.join(include.select("user"), "user", "left_semi")
        else:
            df = df.where(F.col("user").isin(*include))
    if exclude is not None:
        if isinstance(exclude, DataFrame):
            df = df.join(exclude.select("user"), "user", "left_anti")
        else:
            df = df.where(~F.coalesce(F.col("user").isin(*exclude), F.lit(False)))
    return df


def normalise_currency(items: DataFrame, users: DataFrame) -> DataFrame:
    """Prices and costs per wear in the common currency; users without a profile drop out."""
    rate = F.col("exchange_rate")
    return (
        items.join(users.select("user", "exchange_rate"), "user")
        .withColumns({"price": rounded(F.col("price") * rate, 2), "cpw": rounded(F.col("cpw") * rate, 2)})
        .select(*items.columns)
    )


def with_profile(df: DataFrame, users: DataFrame) -> DataFrame:
    """Attach the user profile; users without one drop out."""
    return df.join(users, "user")


def photo_path(name: Column, folder: str = "Photos/", suffix: str = ".png") -> Column:
    return F.concat(F.lit(folder), name, F.lit(suffix))


def item_photos(items: DataFrame) -> DataFrame:
    """One photo path per item."""
    return items.groupBy("user", "item").agg(photo_path(F.min("photo")).alias("photo"))


def with_photo(log: DataFrame, items: DataFrame) -> DataFrame:
    return log.join(item_photos(items), ["user", "item"], "left")


def with_plot_size(
    use: DataFrame, active: float = defaults.PLOT_SIZE_ACTIVE, divested: float = defaults.PLOT_SIZE_DIVESTED
) -> DataFrame:
    """Marker size by status."""
    return use.withColumn("plot_size", F.when(F.col("active"), F.lit(active)).when(~F.col("active"), F.lit(divested)))


def link_table(links: DataFrame, identifier: str) -> DataFrame:
    """Photo links below a folder, in their direct form, without copies."""
    return (
        links.where(F.col("path").contains(identifier))
        .select(
            F.col("name").alias("item"),
            "path",
            F.replace("photo_url", F.lit("?dl=0"), F.lit("?raw=1")).alias("photo_url"),
        )
        .distinct()
    )


def missing_links(files: DataFrame, links: DataFrame) -> DataFrame:
    """Listed photo files for which no link exists."""
    return files.join(links.select("item").distinct(), "item", "left_anti")


def find_items(items: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """Items whose name matches a pattern, for instance a brand."""
    return items.where(F.col("item").rlike(("(?i)" if ignore_case else "") + pattern))


def union_fill(*parts: DataFrame) -> DataFrame:
    """Union by column name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_steps(parts: Iterable[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Daily step extracts that overlap, as one table with one row per day.

    The parts are given from the most to the least trusted one; the first that knows a
    day supplies its value.
    """
    keys = list(keys)
    numbered = [p.select(*keys, "dateTime", "value", F.lit(i).alias("_part")) for i, p in enumerate(parts)]
    return (
        union_fill(*numbered)
        .groupBy(*keys, "dateTime")
        .agg(F.min_by("value", F.struct("_part", "value")).alias("value"))
        .select(*keys, F.try_to_date("dateTime").alias("date"), F.col("value").try_cast("double").alias("steps"))
    )


def intraday(df: DataFrame, date: str = "dateTime", time: str = "dataset_time", value: str = "dataset_value") -> DataFrame:
    """Minute series: day and clock texts to a timestamp, value to a number."""
    kept = [c for c in df.columns if c not in (date, time, value)]
    return df.select(
        *kept,
        F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd HH:mm:ss")).alias("time"),
        F.col(value).try_cast("double").alias("value"),
    )
