"""Frozen items as intervals instead of one carried row per later day.

From an item's last log day on, nothing about it changes. ``usage_spans`` keeps one row for that
rest (``tail``), dated on the first day after the log. Reports by category and day add up what
begins on a day and accumulate along the days, so their shuffle holds log days and one row per
frozen item, whatever the length of the calendar. Only results, which have a row per category and
day, are spread over the days.

All tails end on the last day of the table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog import defaults
from wearlog.functions.numeric import count_if, ratio, strict_sum_if
from wearlog.functions.scalars import _date
from wearlog.operators.cleaning import drop_placeholders, with_plot_size
from wearlog.operators.portfolio import KEYS, with_cost_to_date, with_rolling_use, with_turnaround, with_use_share
from wearlog.operators.usage import MEASURES, _copies, with_cumulative_use, with_days_active, with_item_facts, within_ownership


def with_tails(use: DataFrame, end: Column | dt.date) -> DataFrame:
    """Log days (``tail`` false) and, for items that stop before the end, one more row for the rest."""
    is_last = F.lead("date").over(W.partitionBy(*_copies(use)).orderBy("date")).isNull()
    stops = F.coalesce(is_last & (F.col("date") < _date(end)), F.lit(False))
    kinds = F.when(stops, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return (
        use.withColumn("_kinds", kinds)
        .withColumn("tail", F.explode("_kinds"))
        .withColumn("date", F.when(F.col("tail"), F.date_add("date", 1)).otherwise(F.col("date")))
        .withColumn("used", F.col("used") & ~F.col("tail"))
        .drop("_kinds")
    )


def usage_spans(
    log: DataFrame,
    items: DataFrame,
    start: Column | dt.date,
    end: Column | dt.date,
    placeholders: tuple[str, ...] = defaults.PLACEHOLDER_ITEMS,
) -> DataFrame:
    """``usage_table`` with one row for the frozen rest of an item."""
    use = (
        with_item_facts(drop_placeholders(log, placeholders), items)
        .transform(within_ownership, start, end)
        .transform(with_cumulative_use)
        .transform(with_days_active, start)
    )
    return use.select(*log.columns, *MEASURES, "_copy").transform(with_tails, end).drop("_copy")


def spread(spans: DataFrame, end: Column | dt.date) -> DataFrame:
    """The usage table of spans: every tail as one inactive row per day."""
    days = F.when(F.col("tail"), F.sequence(F.col("date"), _date(end))).otherwise(F.array("date"))
    return (
        spans.withColumn("date", F.explode(days))
        .withColumn("active", ~F.col("tail"))
        .drop("tail")
        .transform(with_plot_size)
    )


def _by_date():
    return W.partitionBy("user", "category").orderBy("date")


def _through(c: str) -> Column:
    """Sum of what has begun up to a day."""
    return F.sum(c).over(_by_date().rowsBetween(W.unboundedPreceding, W.currentRow))


def _filled(days: DataFrame, goes_on: Column, end: Column | dt.date) -> DataFrame:
    """Days up to the next row where something goes on; ``own`` tells the rows that were there."""
    following = F.lead("date").over(_by_date())
    until = F.when(goes_on, F.coalesce(F.date_sub(following, 1), _date(end))).otherwise(F.col("date"))
    return (
        days.withColumn("_until", until)
        .withColumn("_day", F.explode(F.sequence("date", "_until")))
        .withColumn("own", F.col("_day") == F.col("date"))
        .withColumn("date", F.col("_day"))
        .drop("_day", "_until")
    )


def category_days(spans: DataFrame, end: Column | dt.date, one_row_per_day: bool = False) -> DataFrame:
    """``portfolio.category_days`` of the spread table, from its spans."""
    tail, own = F.col("tail"), ~F.col("tail")
    items = count_if(own) if one_row_per_day else F.count_distinct(F.when(own, F.col("item")))
    days = spans.groupBy(*KEYS).agg(
        items.alias("itemcount"),
        strict_sum_if("price", own).alias("categoryvalue"),
        F.max(F.when(own, F.col("used"))).alias("category_used"),
        F.sum(F.when(own, F.col("cumuse"))).alias("cumuse"),
        F.sum(F.when(own, F.col("price"))).alias("category_value"),
        count_if(tail).alias("_tails"),
        F.sum(F.when(tail, F.col("cumuse"))).alias("_tail_cumuse"),
        F.sum(F.when(tail, F.col("price"))).alias("_tail_value"),
    )
    frozen = {"_frozen": "_tails", "_frozen_cumuse": "_tail_cumuse", "_frozen_value": "_tail_value"}
    summed = days.withColumns({name: _through(c) for name, c in frozen.items()})
    some = F.col("_frozen") > 0
    rows = _filled(summed, some, end)
    here = lambda c: F.when(F.col("own"), F.col(c))
    both = lambda c, rest: F.coalesce(here(c), F.lit(0)) + F.coalesce(F.col(rest), F.lit(0))
    return rows.select(
        *KEYS,
        F.coalesce(here("itemcount"), F.lit(0)).alias("itemcount"),
        here("categoryvalue").alias("categoryvalue"),
        F.greatest(here("category_used"), F.when(some, F.lit(False))).alias("category_used"),
        both("cumuse", "_frozen_cumuse").alias("cumuse"),
        both("category_value", "_frozen_value").alias("category_value"),
    )


def category_reports(
    spans: DataFrame, end: Column | dt.date, window: int = 30, one_row_per_day: bool = False, year_days: int = 365
) -> DataFrame:
    """``portfolio.category_reports`` from spans."""
    days = with_rolling_use(category_days(spans, end, one_row_per_day), window)
    turnaround = F.when(F.col("itemcount") > 0, F.col("category_turnaround"))
    days = with_turnaround(days, window).withColumn("category_turnaround", turnaround)
    return with_cost_to_date(with_use_share(days), year_days)


def inventory(spans: DataFrame, end: Column | dt.date, window: int = 30, one_row_per_day: bool = False) -> DataFrame:
    """``portfolio.inventory`` from spans."""
    days = with_rolling_use(category_days(spans, end, one_row_per_day), window).where(F.col("itemcount") > 0)
    return with_turnaround(days, window).drop("cumuse", "category_value")


def use_to_date(spans: DataFrame, end: Column | dt.date, year_days: int = 365) -> DataFrame:
    """``portfolio.use_to_date`` from spans."""
    days = category_days(spans, end, one_row_per_day=True)
    days = days.select(*KEYS, "category_used", "cumuse", "category_value")
    return with_cost_to_date(with_use_share(days), year_days).drop("category_used")


def divested_means(
    spans: DataFrame, end: Column | dt.date, min_days: int = 30, month_days: float = defaults.DAYS_PER_MONTH
) -> DataFrame:
    """The averages of ``portfolio.divested_averages``: a row per category and day with a long-owned divested item."""
    addends = {"uses": F.col("cumuse"), "days": F.col("days_active"), "cost": F.col("cost_per_use") * F.col("cumuse")}
    sums = {f"_{n}": F.sum(c) for n, c in addends.items()} | {f"_no_{n}": count_if(c.isNull()) for n, c in addends.items()}
    begun = spans.where(F.col("tail") & (F.col("days_active") >= min_days))
    days = begun.groupBy(*KEYS).agg(*[c.alias(n) for n, c in sums.items()])
    through = days.withColumns({n: _through(n) for n in sums})
    rows = _filled(through, F.lit(True), end)
    known = {n: F.when(F.col(f"_no_{n}") == 0, F.col(f"_{n}")) for n in addends}
    return rows.select(
        *KEYS,
        (ratio(known["uses"], known["days"]) * month_days).alias("avg_use_per_month_divested"),
        ratio(known["cost"], known["uses"]).alias("avg_cost_per_use_divested"),
    )
