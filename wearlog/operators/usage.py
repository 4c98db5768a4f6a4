"""Usage of each item on each diary day.

All operators of this module work per (user, item) in date order. Log and items are
hash-partitioned by these keys once; joins, running sums and the carry-forward then
follow without a further shuffle. A partition of the windows holds the days of one item,
so its size is bounded by the calendar, however large a user's wardrobe is.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog import defaults
from wearlog.functions.numeric import as_int, count_if, running_sum, strict_sum
from wearlog.functions.scalars import _date, cost_per_use, day_increment, days_before_start, uses_per_month
from wearlog.operators.cleaning import drop_placeholders, photo_path, with_plot_size


def _copies(df: DataFrame) -> list[str]:
    return ["user", "item", *(["_copy"] if "_copy" in df.columns else [])]


def _item_days(df: DataFrame):
    order = [F.asc_nulls_last("rank")] if "rank" in df.columns else []
    return W.partitionBy(*_copies(df)).orderBy(*order, "date")


MEASURES = ("price", "cumuse", "cost_per_use", "days_active", "use_per_month")
FACTS = ("price", "date_purchased", "date_divested", "used_init", "photo")


def with_item_facts(log: DataFrame, items: DataFrame) -> DataFrame:
    """Attach what the item list knows; items that are not listed drop out.

    An item that is listed several times has its log rows once per copy. ``_copy`` numbers them
    by their facts, in the order of FACTS, so that each copy has sums and a last day of its own.
    """
    facts = [c for c in FACTS if c in items.columns]
    order = W.partitionBy("user", "item").orderBy(*[F.asc_nulls_last(c) for c in facts])
    copies = items.select("user", "item", *facts).withColumn("_copy", F.row_number().over(order))
    return log.join(copies, ["user", "item"])


def within_ownership(log: DataFrame, start: Column | dt.date, end: Column | dt.date) -> DataFrame:
    """The days on which an item was owned, for a log that has the item facts already.

    Same rule as ``clip_to_ownership``, without a second pass over the item list.
    """
    start, end = _date(start), _date(end)
    item = W.partitionBy("user", "item")
    return (
        log.withColumn("_from", F.greatest(F.max("date_purchased").over(item), start))
        .withColumn("_to", F.least(F.min("date_divested").over(item), end))
        .where((F.col("date") >= F.col("_from")) & (F.col("date") <= F.col("_to")))
        .drop("_from", "_to")
    )


def with_cumulative_use(log: DataFrame) -> DataFrame:
    """Uses to date and cost per use, from a log with item facts."""
    uses = running_sum(as_int("used"), _item_days(log)) + F.col("used_init")
    return log.withColumn("cumuse", uses).withColumn("cost_per_use", cost_per_use("price", "cumuse"))


def with_days_active(log: DataFrame, start: Column | dt.date, month_days: float = defaults.DAYS_PER_MONTH) -> DataFrame:
    """Days owned to date and uses per month, from a log with cumulative use.

    The first diary day adds the days owned before; without a purchase date the sum is
    unknown from that day on.
    """
    increments = log.withColumn("_days", day_increment("date", "date_purchased", start))
    return (
        increments.withColumn("days_active", running_sum("_days", _item_days(log)).cast("int"))
        .withColumn("use_per_month", uses_per_month("cumuse", "days_active", month_days))
        .drop("_days")
    )


def cumulative_use(log: DataFrame, items: DataFrame) -> DataFrame:
    """Log with running uses and cost per use on each day."""
    return with_cumulative_use(with_item_facts(log, items)).select(*log.columns, "price", "cumuse", "cost_per_use")


def active_use(log: DataFrame, items: DataFrame, start: Column | dt.date) -> DataFrame:
    """Log with uses, cost per use, days owned and monthly use on each day."""
    facts = with_cumulative_use(with_item_facts(log, items))
    return with_days_active(facts, start).select(*log.columns, *MEASURES)


def carry_forward(use: DataFrame, end: Column | dt.date) -> DataFrame:
    """Extend items that stop before the end by one frozen, inactive row per later day.

    The last logged day decides, not the recorded divestment. The rows are generated in
    place from the last one, so nothing is computed or shuffled twice.
    """
    end = _date(end)
    is_last = F.lead("date").over(W.partitionBy(*_copies(use)).orderBy("date")).isNull()
    later = F.when(is_last & (F.col("date") < end), F.sequence(F.col("date"), end))
    return (
        use.withColumn("_days", F.coalesce(later, F.array("date")))
        .withColumn("_day", F.explode_outer("_days"))  # never empty; spares the emptiness test
        .withColumn("active", F.col("_day") == F.col("date"))
        .withColumn("used", F.col("used") & F.col("active"))
        .withColumn("date", F.col("_day"))
        .drop("_days", "_day")
    )


def usage_table(
    log: DataFrame,
    items: DataFrame,
    start: Column | dt.date,
    end: Column | dt.date,
    placeholders: tuple[str, ...] = defaults.PLACEHOLDER_ITEMS,
    photos: bool = True,
) -> DataFrame:
    """The daily item table that all portfolio reports start from.

    The item list is read and shuffled once; every later step keeps the partitioning.
    """
    with_path = photos and "photo" in items.columns
    use = (
        with_item_facts(drop_placeholders(log, placeholders), items)
        .transform(within_ownership, start, end)
        .transform(with_cumulative_use)
        .transform(with_days_active, start)
    )
    if with_path:
        use = use.withColumn("photo", photo_path(F.min("photo").over(W.partitionBy("user", "item"))))
    kept = [*log.columns, *MEASURES, *(["photo"] if with_path else [])]
    return use.select(*kept, "_copy").transform(carry_forward, end).drop("_copy").transform(with_plot_size)


def last_state(
    log: DataFrame,
    items: DataFrame,
    start: Column | dt.date,
    end: Column | dt.date,
    placeholders: tuple[str, ...] = defaults.PLACEHOLDER_ITEMS,
    photos: bool = True,
) -> DataFrame:
    """The last day of ``usage_table``, for a log with one row per item and day at most.

    One grouping of the owned days with partial sums: no day is generated or sorted to be
    dropped again.
    """
    start, end = _date(start), _date(end)
    with_path = photos and "photo" in items.columns
    owned = items.groupBy("user", "item").agg(
        F.max("date_purchased").alias("_from"),
        F.min("date_divested").alias("_to"),
        *([F.min("photo").alias("_photo")] if with_path else []),
    )
    first, last = F.greatest(F.col("_from"), start), F.least(F.col("_to"), end)
    days = drop_placeholders(log, placeholders).join(owned, ["user", "item"]).where((F.col("date") >= first) & (F.col("date") <= last))
    others = [c for c in log.columns if c not in ("user", "item", "date")]
    sums = days.groupBy("user", "item").agg(
        F.max_by(F.struct(*others), "date").alias("_last"),
        F.max("date").alias("_last_day"),
        strict_sum(as_int("used")).alias("_uses"),
        F.count(F.lit(1)).alias("_days"),
        count_if(F.col("date") == start).alias("_first_days"),
        *([F.min("_photo").alias("_photo")] if with_path else []),
    )
    facts = [c for c in FACTS if c in items.columns and c != "photo"]
    before = F.when(F.col("_first_days") == 0, F.lit(0)).otherwise(F.col("_first_days") * days_before_start("date_purchased", start))
    state = (
        sums.join(items.select("user", "item", *facts), ["user", "item"])
        .withColumn("cumuse", F.col("_uses") + F.col("used_init"))
        .withColumn("cost_per_use", cost_per_use("price", "cumuse"))
        .withColumn("days_active", (F.col("_days") - F.col("_first_days") + before).cast("int"))
        .withColumn("use_per_month", uses_per_month("cumuse", "days_active", defaults.DAYS_PER_MONTH))
        .withColumn("active", F.col("_last_day") == end)
        .withColumn("date", end)
        .withColumns({c: F.col("_last")[c] for c in others})
        .withColumn("used", F.col("used") & F.col("active"))
    )
    if with_path:
        state = state.withColumn("photo", photo_path("_photo"))
    kept = [*log.columns, *MEASURES, *(["photo"] if with_path else []), "active"]
    return state.select(*kept).transform(with_plot_size)


def latest(df: DataFrame, column: str = "date", last: Column | dt.date | None = None) -> DataFrame:
    """Rows of the last date that the table has.

    The date is found by a second pass over the column, which is cheap on a saved table;
    give ``last`` where it is known, as in a table that was carried forward to it.
    """
    last = df.select(F.max(column)).scalar() if last is None else _date(last)
    return df.where(F.col(column) == last)


def thin_dates(df: DataFrame, step: int = 2, column: str = "date") -> DataFrame:
    """Rows of every ``step``-th distinct date, starting with the first.

    The list of distinct dates is bounded by the calendar (about 37,000 per century), so
    one task may number it. It is broadcast: Spark estimates its size from the rows it is taken
    from, and would shuffle all rows by date where there are many.
    """
    dates = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = dates.withColumn("_n", F.row_number().over(W.orderBy(column)))
    kept = numbered.where((F.col("_n") - 1) % step == 0).select(column)
    return df.join(F.broadcast(kept), column, "left_semi")


def log_gaps(use: DataFrame, items: DataFrame) -> DataFrame:
    """Items that look divested by their log but have no divestment date."""
    passive = use.where(~F.col("active")).select("user", "item").distinct()
    undated = items.groupBy("user", "item").agg(F.max("date_divested").alias("_divested"))
    return passive.join(undated.where(F.col("_divested").isNull()), ["user", "item"]).select("user", "item")
