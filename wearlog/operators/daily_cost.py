"""Cost of the items used on a day, at the lowest cost per use each item ever reached."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog import defaults
from wearlog.functions.numeric import rolling, strict_sum
from wearlog.operators.usage import thin_dates


def _strict_min(c: str) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), F.min(c))


def _selected(use: DataFrame, include: Sequence[str] | None, exclude: Sequence[str]) -> DataFrame:
    """Rows of the wanted categories; by default every known category that is not excluded."""
    category = F.col("category")
    use = use.where(category.isNotNull() if include is None else category.isin(*include))
    if exclude:
        use = use.where(~category.isin(*exclude))
    return use


def with_midpoint_average(days: DataFrame, keys: Sequence[str], window: int, min_rows: int | None = None) -> DataFrame:
    """Trailing mean over rows, moved to the middle of its window."""
    by_date = W.partitionBy(*keys).orderBy("date")
    if min_rows == 1:  # a mean is null without a known value, so none needs to be counted
        mean = F.avg("daily_cost").over(by_date.rowsBetween(-(window - 1), W.currentRow))
    else:
        mean = rolling(F.avg("daily_cost"), by_date, window, min_rows, of="daily_cost")
    return (
        days.withColumn("_mean", mean)
        .withColumn("average_daily_cost", F.lead("_mean", round(window / 2)).over(by_date))
        .drop("_mean")
    )


def daily_cost(
    use: DataFrame,
    window: int = 30,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = defaults.COST_EXCLUDED_CATEGORIES,
    by_category: bool = False,
) -> DataFrame:
    """Cost of the used items per day, with its rolling mean.

    The lowest cost per item is a small aggregate; only the rows of used days are joined
    to it and shuffled. ``by_category`` gives all categories in the same job.
    """
    keys = ["user", "category"] if by_category else ["user"]
    rows = _selected(use, include, exclude)
    state = rows.groupBy("user", "item").agg(
        _strict_min("cost_per_use").alias("_cost"), F.bool_and("active").alias("_active")
    )
    days = (
        rows.where("used")
        .select("user", "category", "item", "date")
        .join(state, ["user", "item"])
        .groupBy(*keys, "date")
        .agg(strict_sum("_cost").alias("daily_cost"), F.bool_or("_active").alias("still_active"))
    )
    return with_midpoint_average(days, keys, window)


def _report_numbers(days: DataFrame) -> tuple[Column, Callable[[str], Column]]:
    """The report days in order, and a function from a date column to the number (from 1) of the next of them.

    The number is null behind the last report day. Both look into one-row subqueries over the list of
    report days, whose length the calendar bounds: no row is joined or shuffled to be numbered.
    """
    ordered = F.sort_array(F.collect_set("day"))  # without null
    first = days.select(F.min("day")).scalar()
    numbers = days.select(ordered.alias("_days")).select(
        F.flatten(
            F.transform(
                "_days",
                lambda day, i: F.array_repeat(i + 1, F.when(i == 0, F.lit(1)).otherwise(F.datediff(day, F.get("_days", i - 1)))),
            )
        )
    ).scalar()

    def number(date: str) -> Column:
        return F.get(numbers, F.when(F.col(date) < first, F.lit(0)).otherwise(F.datediff(date, first)))

    return days.select(ordered).scalar(), number


def _item_histories(rows: DataFrame) -> DataFrame:
    """A row per item: the days on which it was used, and its state from each report day on that changes it.

    The state is the lowest cost so far, whether a cost was unknown, and whether all days were active.
    """
    by_report = W.partitionBy("user", "item").orderBy("_n")
    so_far = by_report.rangeBetween(W.unboundedPreceding, W.currentRow)  # all rows up to the report day
    unknown = F.max(F.col("cost_per_use").isNull().cast("int")).over(so_far)
    states = (
        rows.select(
            "user",
            "item",
            "_n",
            F.when(F.col("used"), F.col("date")).alias("_used"),
            F.when(unknown == 0, F.min("cost_per_use").over(so_far)).otherwise(F.lit(0.0)).alias("cost"),
            unknown.alias("unknown"),
            F.min(F.col("active").cast("int")).over(so_far).alias("active"),
        )
        .withColumn("_state", F.struct("cost", "unknown", "active"))
        .withColumn("_old", F.lag("_state").over(by_report))
        .withColumn("_change", F.when(F.col("_old").isNull() | (F.col("_state") != F.col("_old")), F.struct("_n", "cost", "unknown", "active")))
    )
    kept = states.where(F.col("_used").isNotNull() | F.col("_change").isNotNull())
    histories = kept.groupBy("user", "item").agg(F.collect_list("_used").alias("_used"), F.collect_list("_change").alias("_changes"))
    return histories.where(F.size("_used") > 0).withColumn("_changes", F.sort_array("_changes"))


def daily_cost_asof(
    use: DataFrame,
    days: DataFrame,
    window: int = 30,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = defaults.COST_EXCLUDED_CATEGORIES,
    parts: int | None = None,
) -> DataFrame:
    """Daily cost as it stood on each report day (column ``day``), from the rows up to that day.

    The result has a row per report day and earlier day by definition. An item keeps only the
    report days on which its lowest cost or its status changes. A used day emits its item's state
    on the next report day and then one difference per change; differences are summed by user, day
    used and report day, accumulated, and held until the next change.

    ``use`` is read once. What is shuffled by user is one row per item, with its used days and its
    changes; a used day meets the changes only where the sums are spread and averaged, as their pairs
    are many times what the two lists are. There, a user's rows are bounded by report days and calendar.
    Item rows are few bytes before that, so ``parts``, the number of tasks for it, should be given
    where the result is large.
    """
    reports, number = _report_numbers(days)
    rows = (
        _selected(use, include, exclude)
        .where(F.col("user").isNotNull() & F.col("item").isNotNull())
        .select("user", "item", "date", "cost_per_use", "active", "used", number("date").alias("_n"))
        .where(F.col("_n").isNotNull())
    )
    histories = _item_histories(rows).select("user", "_used", "_changes")
    placed = histories.repartition("user") if parts is None else histories.repartition(parts, "user")
    steps = F.transform(
        "_changes",
        lambda change, i: F.named_struct(
            F.lit("state"), change, F.lit("old"), F.get("_changes", i - 1), F.lit("to"), F.get("_changes", i + 1)["_n"]
        ),
    )
    changes = (
        placed.select("user", F.explode("_used").alias("date"), steps.alias("_steps"))
        .select("user", "date", number("date").alias("_n"), F.explode("_steps").alias("_step"))
        .where(F.col("_step.to").isNull() | (F.col("_step.to") > F.col("_n")))
        .withColumn("_first", F.col("_step.state._n") <= F.col("_n"))
    )
    sums = [
        F.sum(F.col(f"_step.state.{c}") - F.when(F.col("_first"), F.lit(0)).otherwise(F.col(f"_step.old.{c}"))).alias(f"_{c}")
        for c in ("cost", "unknown", "active")
    ]
    by_report = W.partitionBy("user", "date").orderBy("_n")
    summed = changes.groupBy("user", "date", F.greatest("_n", "_step.state._n").alias("_n")).agg(*sums)
    held = summed.select(
        "user",
        "date",
        *[F.sum(f"_{c}").over(by_report.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(f"_{c}") for c in ("cost", "unknown", "active")],
        F.slice(reports, F.col("_n"), F.coalesce(F.lead("_n").over(by_report), F.size(reports) + 1) - F.col("_n")).alias("_days"),
    )
    costs = held.select(
        "user",
        F.explode("_days").alias("day"),
        "date",
        F.when(F.col("_unknown") == 0, F.col("_cost")).alias("daily_cost"),
        (F.col("_active") > 0).alias("still_active"),
    )
    return with_midpoint_average(costs, ["user", "day"], window, min_rows=1)


def trim_days(
    df: DataFrame, start: Column | dt.date, end: Column | dt.date, window: int = 30, step: int = 1, column: str = "day"
) -> DataFrame:
    """Report days with a full window on either side, optionally only every ``step``-th."""
    start, end = (F.lit(d) if isinstance(d, dt.date) else d for d in (start, end))
    kept = df.where(
        (F.col(column) >= F.date_add(start, window - 1)) & (F.col(column) <= F.date_sub(end, window))
    )
    return kept if step == 1 else thin_dates(kept, step, column)
