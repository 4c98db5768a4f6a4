"""Repairs and divestments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearlog.functions.numeric import loose_sum, ratio, rounded, strict_sum
from wearlog.operators.study import NOT_DIVESTED, crosstab


def repaired_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("repaired") > 0)


def repairs_by_user(items: DataFrame) -> DataFrame:
    """Repaired items and their value per user that has any."""
    return repaired_items(items).groupBy("user").agg(
        F.count(F.lit(1)).alias("repaired_items"), loose_sum("price").alias("repaired_value")
    )


def repairs_by_category(items: DataFrame) -> DataFrame:
    return repaired_items(items).groupBy("category").agg(F.count(F.lit(1)).alias("repaired_items"))


def repair_counts(items: DataFrame) -> DataFrame:
    """All items and number of repairs per user."""
    return items.groupBy("user").agg(
        F.count(F.lit(1)).alias("items"), loose_sum("repaired").alias("repaired")
    )


def needing_repair(items: DataFrame) -> DataFrame:
    return items.where(F.col("item").isNotNull() & F.col("needs_repair"))


def repair_needs_by_user(items: DataFrame, active_only: bool = True) -> DataFrame:
    """Items that need repair and their value per user."""
    rows = needing_repair(items)
    return (rows.where(NOT_DIVESTED) if active_only else rows).groupBy("user").agg(
        F.count(F.lit(1)).alias("total_items"), loose_sum("price").alias("total_value")
    )


def repair_delta(items: DataFrame) -> DataFrame:
    """Items in need of repair at the start or the end, beside the repairs made."""
    return items.where(NOT_DIVESTED).where(
        (F.col("needs_repair_start") | F.col("needs_repair")) & F.col("needs_repair").isNotNull()
    ).select("user", "category", "item", "needs_repair_start", "needs_repair", "repaired")


def repair_reasons(items: DataFrame) -> DataFrame:
    """Why items were not repaired: number and value."""
    return needing_repair(items).groupBy("reason_not_repaired").agg(
        F.count(F.lit(1)).alias("items"), strict_sum("price").alias("value")
    )


def repair_crosstab(items: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Items in need of repair by two attributes, empty cells 0, with unknown and unlisted values."""
    return crosstab(needing_repair(items), row, column, values, fill=0, unknown="unknown", other="other")


def divested_in_study(items: DataFrame, start: dt.date | None) -> DataFrame:
    if start is None:
        return items.where(F.col("date_divested").isNotNull())
    return items.where(F.col("date_divested") > F.lit(start))


def divestments(items: DataFrame, by: str, start: dt.date | None = None) -> DataFrame:
    """Divested items by way or condition, with their share of all."""
    rows = divested_in_study(items, start)
    n = rows.select(F.count(F.lit(1))).scalar()
    return (
        rows.groupBy(by)
        .agg(F.count(F.lit(1)).alias("items_divested"))
        .withColumn("share_of_total", rounded(ratio("items_divested", n), 2))
    )


def divestment_matrix(
    items: DataFrame, row: str, ways: Sequence[str], start: dt.date | None = None
) -> DataFrame:
    """Divested items by an attribute and the way they went, with unknown and unlisted ways."""
    return crosstab(divested_in_study(items, start), row, "divestment_way", ways, unknown="unknown", other="other")
