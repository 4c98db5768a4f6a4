"""Item and category listings for the last day, and the times-used ranking."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog import defaults
from wearlog.functions.numeric import ratio, rounded, strict_sum
from wearlog.operators.joins import join_null_safe
from wearlog.operators.ordered import exact_quantiles, large_groups, row_positions
from wearlog.operators.usage import latest

KEYS = ["user", "category", "date"]
Last = Column | dt.date | None
BANDS = {"std1_low": 0.32, "std1_high": 0.68, "std2_low": 0.05, "std2_high": 0.95}


def item_listing(use: DataFrame, last: Last = None, month_days: float = defaults.DAYS_PER_MONTH) -> DataFrame:
    """Items as of the last day: uses, cost per wear, wears and months, status."""
    return latest(use, last=last).select(
        "user",
        "category",
        "item",
        "price",
        F.col("cumuse").alias("times_worn"),
        rounded("cost_per_use", 2).alias("cost_per_wear"),
        rounded("use_per_month", 1).alias("wears_per_month"),
        rounded(F.col("days_active") / F.lit(month_days), 0).alias("months_active"),
        F.when(F.col("active"), F.lit("Active")).otherwise(F.lit("Divested")).alias("status"),
    )


def item_listing_order(dim_ranked: DataFrame) -> DataFrame:
    """Listing in report order; needs the category rank."""
    return dim_ranked.orderBy(
        "user", F.asc_nulls_last("rank"), "status", F.desc_nulls_last("times_worn"), "item"
    )


def category_listing(reports: DataFrame, dim: DataFrame, totals: bool = True, last: Last = None) -> DataFrame:
    """Categories as of the last day, with a totals row on top of each wardrobe.

    Reads ``portfolio.category_reports``. Categories without active items drop out. The turnover of the totals row follows from
    the totals; measures that do not add up are empty there. Each row is also counted under
    the total, so both levels come from one pass.
    """
    rows = (
        latest(reports, last=last)
        .where(F.col("itemcount") > 0)
        .join(dim.select("category", "rank"), "category", "left")
        .select(
            "user", "category", "rank", "itemcount", "categoryvalue", "daily_cost", "category_use", "yearly_cost"
        )
    )
    if totals:
        own = F.struct("category", "rank", "daily_cost", "category_use")
        total = F.struct(
            F.lit("Total").alias("category"),
            F.lit(0).alias("rank"),
            F.lit(None).cast("double").alias("daily_cost"),
            F.lit(None).cast("double").alias("category_use"),
        )
        rows = (
            rows.select(
                "user", "itemcount", "categoryvalue", "yearly_cost", F.explode(F.array(own, total)).alias("_level")
            )
            .groupBy("user", "_level.category", "_level.rank")
            .agg(
                F.sum("itemcount").alias("itemcount"),
                strict_sum("categoryvalue").alias("categoryvalue"),
                F.max("_level.daily_cost").alias("daily_cost"),
                F.max("_level.category_use").alias("category_use"),
                strict_sum("yearly_cost").alias("yearly_cost"),
            )
        )
    return rows.withColumn("turnover", ratio("yearly_cost", "categoryvalue"))


def _chosen(use: DataFrame, categories: Sequence[str] | None, pooled: bool) -> tuple[DataFrame, list[str]]:
    """Rows of the categories (all by default), and the keys of a ranking; pooled leaves out the category."""
    use = use if categories is None else use.where(F.col("category").isin(*categories))
    return use, ["user", "date"] if pooled else KEYS


def use_bands(use: DataFrame, categories: Sequence[str] | None = None, pooled: bool = False) -> DataFrame:
    """Range of uses of the divested items per category and date, or of several categories together."""
    use, keys = _chosen(use, categories, pooled)
    return exact_quantiles(use.where(~F.col("active")), keys, "cumuse", BANDS)


def _ranked_by_window(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row number and bands for groups that a task may hold: one shuffle and one sort give both."""
    group = W.partitionBy(*keys).orderBy(*order)
    value = F.col("cumuse").cast("double")
    divested = F.when(~F.col("active") & ~F.isnan(value), value)
    bands = F.percentile(divested, [*BANDS.values()]).over(group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranked = rows.withColumns({"rownumber": F.row_number().over(group).cast("long"), "_bands": bands})
    return ranked.withColumns({name: F.col("_bands")[i] for i, name in enumerate(BANDS)}).drop("_bands")


def _ranked_in_pieces(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], pooled: bool) -> DataFrame:
    """The same for groups of any size."""
    return join_null_safe(row_positions(rows, keys, order, "rownumber"), use_bands(rows, pooled=pooled), keys, "left")


def times_used(
    use: DataFrame, last_only: bool = True, last: Last = None, categories: Sequence[str] | None = None, pooled: bool = False
) -> DataFrame:
    """Items ranked by status and age per category and date, with the band of divested items.

    ``pooled`` ranks the chosen categories of a user together. A user's category (pooled: a user) with
    very many rows over all dates is ranked in pieces, the others by one window.
    """
    use, keys = _chosen(use, categories, pooled)
    rows = latest(use, last=last) if last_only else use
    narrow = rows.select(*KEYS, "item", "cumuse", "days_active", "active")
    order = [F.col("active").asc(), F.desc_nulls_last("days_active"), F.col("item").asc()]
    dated = [k for k in keys if k != "date"]
    large = large_groups(narrow, dated)
    if large is None:
        return _ranked_by_window(narrow, keys, order)
    few, many = (join_null_safe(narrow, large, dated, how) for how in ("left_anti", "left_semi"))
    return _ranked_by_window(few, keys, order).unionByName(_ranked_in_pieces(many, keys, order, pooled))
