"""Daily steps shared out over the shoes worn."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog.functions.numeric import as_int, rounded, running_sum
from wearlog.functions.scalars import _date
from wearlog.operators.ordered import row_positions

COLUMNS = ["user", "item", "date", "used", "cumuse", "days_active", "active"]


def allocate_steps(use: DataFrame, steps: DataFrame) -> DataFrame:
    """Split the steps of a day evenly over the items used; days without steps drop out.

    Uses are counted per day first, so the daily table that joins back is small.
    """
    worn = use.groupBy("user", "date").agg(F.greatest(F.sum(as_int("used")), F.lit(1)).alias("_worn"))
    per_item = steps.join(worn, ["user", "date"]).select(
        "user", "date", F.col("steps").alias("_steps"), "_worn"
    )
    return (
        use.select(*COLUMNS)
        .join(per_item, ["user", "date"])
        .withColumn("steps", F.col("_steps") * as_int("used") / F.col("_worn"))
        .select(*COLUMNS, "steps")
    )


def cumulative_steps(allocated: DataFrame, start: Column | dt.date) -> DataFrame:
    """Steps to date per item, with an opening balance for items used before the diary.

    The balance is the mean of the item's step days times its uses on the first day; that
    day's own use counts in it too.
    """
    item = W.partitionBy("user", "item")
    mean = F.avg(F.when(F.col("steps") > 0, F.col("steps"))).over(item)
    opening_uses = F.max(F.when((F.col("date") == _date(start)) & (F.col("cumuse") > 0), F.col("cumuse"))).over(item)
    balance = F.coalesce(rounded(mean * opening_uses, 0), F.lit(0.0))
    running = running_sum("steps", item.orderBy("date"))
    return allocated.withColumn("cumsteps", running + balance)


def total_steps(cumulative: DataFrame) -> DataFrame:
    """Total per item on its last day, ranked by status and steps."""
    totals = cumulative.groupBy("user", "item").agg(
        F.max("date").alias("date"),
        F.max("cumsteps").alias("cumsteps"),
        F.max_by("active", "date").alias("active"),
    )
    order = [F.col("active").asc(), F.desc_nulls_last("cumsteps"), F.col("item").asc()]
    return row_positions(totals, ["user"], order, "rownumber")
