"""Category by date reports over the daily item table.

Everything that is counted per user, category and day comes from one aggregation, with
partial sums before the shuffle; rolling and running measures then work on one row per
day, which the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog import defaults
from wearlog.functions.numeric import as_int, count_if, loose_sum, ratio, rolling, strict_sum, strict_sum_if
from wearlog.operators.cleaning import union_fill
from wearlog.operators.joins import join_null_safe

KEYS = ["user", "category", "date"]

# The report columns itemcount, categoryvalue, rolling_category_use, category_turnaround,
# category_use, daily_cost, yearly_cost, inventoryvalue, avg_use_per_month_divested and
# avg_cost_per_use_divested are named as their readers expect.


def with_price(use: DataFrame, items: DataFrame) -> DataFrame:
    """Attach the price by user, category and item, for tables that do not carry it."""
    prices = items.select("user", "category", "item", "price")
    return use.drop("price").join(prices, ["user", "category", "item"])


def category_days(use: DataFrame, one_row_per_day: bool = False) -> DataFrame:
    """All additive measures per user, category and date.

    ``one_row_per_day`` states that an item has one row per day at most, so active items
    need not be counted as distinct and no item leaves its map task.
    """
    active = F.col("active")
    items = count_if(active) if one_row_per_day else F.count_distinct(F.when(active, F.col("item")))
    return use.groupBy(*KEYS).agg(
        items.alias("itemcount"),
        strict_sum_if("price", active).alias("categoryvalue"),
        F.max("used").alias("category_used"),
        loose_sum("cumuse").alias("cumuse"),
        loose_sum("price").alias("category_value"),
    )


def active_items(use: DataFrame) -> DataFrame:
    """Number of active items."""
    return use.where("active").groupBy(*KEYS).agg(F.count_distinct("item").alias("itemcount"))


def active_value(use: DataFrame) -> DataFrame:
    """Purchase value of the active items; unknown if any price is."""
    return use.where("active").groupBy(*KEYS).agg(strict_sum("price").alias("categoryvalue"))


def _by_date():
    return W.partitionBy("user", "category").orderBy("date")


def with_rolling_use(days: DataFrame, window: int = 30) -> DataFrame:
    """Share of the last ``window`` rows on which the category was used."""
    used = rolling(F.sum(as_int("category_used")), _by_date(), window)
    return days.withColumn("rolling_category_use", used / F.lit(float(window)))


def rolling_category_use(use: DataFrame, window: int = 30) -> DataFrame:
    days = use.groupBy(*KEYS).agg(F.max("used").alias("category_used"))
    return with_rolling_use(days, window)


def with_turnaround(days: DataFrame, window: int = 30) -> DataFrame:
    """Monthly uses of the category per active item."""
    uses = F.col("rolling_category_use") * F.lit(float(window))
    return days.withColumn("category_turnaround", ratio(uses, "itemcount"))


def inventory(use: DataFrame, window: int = 30, one_row_per_day: bool = False) -> DataFrame:
    """Active items, their value, rolling use and turnaround; days without active items drop out."""
    days = with_rolling_use(category_days(use, one_row_per_day), window).where(F.col("itemcount") > 0)
    return with_turnaround(days, window).drop("cumuse", "category_value")


def with_use_share(days: DataFrame) -> DataFrame:
    """Share of the days since the first one on which the category was used."""
    w = _by_date().rowsBetween(W.unboundedPreceding, W.currentRow)
    used_days = F.sum(as_int("category_used")).over(w)
    elapsed = F.datediff("date", F.min("date").over(w)) + 1
    return days.withColumn("category_use", ratio(used_days, elapsed))


def use_to_date(use: DataFrame, year_days: int = 365) -> DataFrame:
    """Cost per wear to date, share of days used and yearly cost, over all items ever owned."""
    days = use.groupBy(*KEYS).agg(
        F.max("used").alias("category_used"),
        loose_sum("cumuse").alias("cumuse"),
        loose_sum("price").alias("category_value"),
    )
    return with_cost_to_date(with_use_share(days), year_days).drop("category_used")


def with_cost_to_date(days: DataFrame, year_days: int = 365) -> DataFrame:
    """Cost per wear to date and yearly cost, from days with the share of days used."""
    yearly = F.col("daily_cost") * year_days * F.col("category_use")
    return days.withColumn("daily_cost", ratio("category_value", "cumuse")).withColumn("yearly_cost", yearly)


def category_reports(use: DataFrame, window: int = 30, one_row_per_day: bool = False, year_days: int = 365) -> DataFrame:
    """All columns of ``inventory`` and ``use_to_date`` in one table, from one grouping.

    Days without active items are kept, with ``itemcount`` 0.
    """
    days = with_rolling_use(category_days(use, one_row_per_day), window)
    turnaround = F.when(F.col("itemcount") > 0, F.col("category_turnaround"))
    days = with_turnaround(days, window).withColumn("category_turnaround", turnaround)
    return with_cost_to_date(with_use_share(days), year_days)


def with_monthly_cost(use_to_date_table: DataFrame) -> DataFrame:
    return use_to_date_table.withColumn("monthly_cost", F.col("yearly_cost") / F.lit(12.0))


def inventory_total(use: DataFrame, exclude: Sequence[str] = defaults.COST_EXCLUDED_CATEGORIES) -> DataFrame:
    """Active value per day over all but some categories; items without category are left out."""
    kept = use.where(F.col("active") & F.col("category").isNotNull())
    if exclude:
        kept = kept.where(~F.col("category").isin(*exclude))
    return kept.groupBy("user", "date").agg(strict_sum("price").alias("inventoryvalue"))


def with_category_photo(days: DataFrame, dim: DataFrame) -> DataFrame:
    """Attach the category photo; categories without one drop out."""
    return days.join(dim.select("category", F.col("category_photo").alias("photo")), "category")


def divested_averages(use: DataFrame, min_days: int = 30, month_days: float = defaults.DAYS_PER_MONTH) -> DataFrame:
    """Use-weighted averages of long-owned divested items, attached to the rows of these items."""
    counts = ~F.col("active") & (F.col("days_active") >= min_days)
    averages = (
        use.where(counts)
        .groupBy(*KEYS)
        .agg(
            strict_sum("cumuse").alias("_uses"),
            strict_sum("days_active").alias("_days"),
            strict_sum(F.col("cost_per_use") * F.col("cumuse")).alias("_cost"),
        )
        .select(
            *KEYS,
            (ratio("_uses", "_days") * month_days).alias("_monthly"),
            ratio("_cost", "_uses").alias("_per_use"),
        )
    )
    names = {"_monthly": "avg_use_per_month_divested", "_per_use": "avg_cost_per_use_divested"}
    # Rows that cannot match are passed on where they are.
    others = use.where(~F.coalesce(counts, F.lit(False)))
    found = join_null_safe(use.where(counts), averages, KEYS, "left").withColumnsRenamed(names)
    return found.unionByName(others.withColumns({name: F.lit(None).cast("double") for name in names.values()}))


def compare(latest_use: DataFrame, comparison: DataFrame) -> DataFrame:
    """Own categories on the last date beside external products, by monthly cost."""
    own = with_monthly_cost(latest_use).select(
        "user", "category", "category_use", "monthly_cost", "photo", F.lit(False).alias("comparison"), "date"
    )
    last = latest_use.select(F.max("date")).scalar()
    external = comparison.select(
        F.col("Category").alias("category"),
        "photo",
        F.col("`monthly cost`").try_cast("double").alias("monthly_cost"),
        F.col("`category use`").try_cast("double").alias("category_use"),
        F.lit(True).alias("comparison"),
        last.alias("date"),
    )
    return union_fill(own, external)
