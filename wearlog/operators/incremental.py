"""Usage of new log days from the state of each item, without the days before.

The state has the last log row of each copy of an item, with its running sums. New log days
continue these sums, and the last of them becomes the copy's new state: ``fold`` is associative,
so days may be added in any portions. Days before are not read and not changed. The frozen rest of
an item follows from its state (``tails``) and is not stored; so an item that is used again after
months leaves nothing behind that would have to be taken back.

A log has one row per item and day at most, and comes in the order of days: rows for days that were
folded already, and first facts of an item with such days, are not seen. Items whose facts changed
for such days are found by ``needs_rebuild``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog import defaults
from wearlog.functions.numeric import as_int, running_sum
from wearlog.functions.scalars import _date, cost_per_use, day_increment, uses_per_month
from wearlog.operators.cleaning import drop_placeholders
from wearlog.operators.usage import MEASURES

#: What a copy's sums are made of.
FACTS = ("price", "date_purchased", "used_init")
COPY = ("user", "item", "_copy")
#: Columns of the state beside those of the usage table.
SUMS = ("_copy", "_uses", "_days", "date_purchased", "used_init", "_to")


def item_copies(items: DataFrame) -> DataFrame:
    """The copies of each item by their facts, and from when to when the item was owned."""
    item = W.partitionBy("user", "item")
    return items.select(
        "user",
        "item",
        *FACTS,
        F.row_number().over(item.orderBy(*[F.asc_nulls_last(c) for c in FACTS])).alias("_copy"),
        F.max("date_purchased").over(item).alias("_from"),
        F.min("date_divested").over(item).alias("_to"),
    )


def new_days(
    log: DataFrame,
    items: DataFrame,
    start: Column | dt.date,
    end: Column | dt.date,
    state: DataFrame | None = None,
    placeholders: tuple[str, ...] = defaults.PLACEHOLDER_ITEMS,
    month_days: float = defaults.DAYS_PER_MONTH,
) -> DataFrame:
    """Owned days of a log with the measures of the usage table, continued from a state.

    ``log`` has only days behind those of the state. One shuffle by user and item.
    """
    if "rank" in log.columns:
        raise ValueError("days that are ordered by rank cannot be continued")
    start, end = _date(start), _date(end)
    days = (
        drop_placeholders(log, placeholders)
        .join(item_copies(items), ["user", "item"])
        .where((F.col("date") >= F.greatest("_from", start)) & (F.col("date") <= F.least("_to", end)))
    )
    before = {"_uses": F.lit(0), "_days": F.lit(0)}
    if state is not None:
        known = state.select(*COPY, F.col("_uses").alias("_uses_before"), F.col("_days").alias("_days_before"), F.lit(True).alias("_known"))
        days = days.join(known, list(COPY), "left")
        before = {c: F.when(F.col("_known"), F.col(f"{c}_before")).otherwise(zero) for c, zero in before.items()}
    order = W.partitionBy(*COPY).orderBy("date")
    increments = days.withColumn("_step", day_increment("date", "date_purchased", start))
    return (
        increments.withColumn("_uses", before["_uses"] + running_sum(as_int("used"), order))
        .withColumn("_days", before["_days"] + running_sum("_step", order))
        .withColumn("cumuse", F.col("_uses") + F.col("used_init"))
        .withColumn("cost_per_use", cost_per_use("price", "cumuse"))
        .withColumn("days_active", F.col("_days").cast("int"))
        .withColumn("use_per_month", uses_per_month("cumuse", "days_active", month_days))
        .select(*log.columns, *MEASURES, *SUMS)
    )


def fold(days: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state after some days: the last row of each copy, with partial results before the shuffle."""
    rows = days if state is None else days.unionByName(state)
    others = [c for c in rows.columns if c not in COPY]
    last = rows.groupBy(*COPY).agg(F.max_by(F.struct(*others), "date").alias("_last"))
    return last.select(*COPY, "_last.*").select(*rows.columns)


def tails(state: DataFrame, end: Column | dt.date) -> DataFrame:
    """The frozen rest of the items whose log stops before the end, as in ``tails.with_tails``."""
    return (
        state.where(F.col("date") < _date(end))
        .withColumn("date", F.date_add("date", 1))
        .withColumn("used", F.col("used") & F.lit(False))
        .withColumn("tail", F.lit(True))
    )


def needs_rebuild(state: DataFrame, items: DataFrame, upto: Column | dt.date) -> DataFrame:
    """Items of the state whose facts changed for days that are folded already: user, item.

    That is another number of copies, another price, purchase date or number of initial uses, or an end
    of ownership that differs within these days. A new end behind them changes nothing.
    """
    upto = _date(upto)

    def signature(table: DataFrame, name: str) -> DataFrame:
        facts = F.sort_array(F.collect_list(F.struct(*FACTS)))
        return table.groupBy("user", "item").agg(facts.alias(f"{name}_facts"), F.least(F.min("_to"), upto).alias(f"{name}_to"))

    listed = signature(item_copies(items), "new")
    both = signature(state, "old").join(listed, ["user", "item"], "left")
    same = F.col("old_facts").eqNullSafe(F.col("new_facts")) & F.col("old_to").eqNullSafe(F.col("new_to"))
    return both.where(~same).select("user", "item")
