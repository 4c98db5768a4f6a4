"""Item by day queries (U)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry import tables as t
from registry.catalog import query
from wearlog.operators import usage
from wearlog.operators.cleaning import clip_to_ownership
from wearlog.plans import increments
from wearlog.plans.reports import cost_per_wear_today
from wearlog.sources import storage

KEYS = ["user", "category", "item", "date"]


def clipped(spark, d):
    return clip_to_ownership(t.log(spark, d), t.items(spark, d), t.START, t.end(spark, d))


def owned(spark, d):
    """Owned days with the facts of their items."""
    facts = usage.with_item_facts(t.log(spark, d), t.items(spark, d))
    return usage.within_ownership(facts, t.START, t.end(spark, d))


def active(spark, d):
    return usage.with_days_active(usage.with_cumulative_use(owned(spark, d)), t.START)


@query("U1_cumulative_use", 'SELECT "user", category, item, date, used, cumuse FROM cum')
def cumulative_use(spark, d):
    return usage.cumulative_use(clipped(spark, d), t.items(spark, d)).select(*KEYS, "used", "cumuse")


@query("U2_cost_per_use", 'SELECT "user", category, item, date, cumuse, price, cost_per_use FROM cum')
def cost_per_use(spark, d):
    return usage.with_cumulative_use(owned(spark, d)).select(*KEYS, "cumuse", "price", "cost_per_use")


@query("U3_days_active", 'SELECT "user", category, item, date, days_active FROM active_use')
def days_active(spark, d):
    return active(spark, d).select(*KEYS, "days_active")


@query(
    "U4_unknown_days_active",
    """
SELECT "user", category, item, count(*) AS log_days, count(days_active) AS known_days,
       min(CASE WHEN days_active IS NULL THEN date END) AS unknown_from
FROM active_use GROUP BY "user", category, item
""",
)
def unknown_days(spark, d):
    """Per item, from when on its days of ownership are unknown."""
    return active(spark, d).groupBy("user", "category", "item").agg(
        F.count(F.lit(1)).alias("log_days"),
        F.count("days_active").alias("known_days"),
        F.min(F.when(F.col("days_active").isNull(), F.col("date"))).alias("unknown_from"),
    )


@query("U5_use_per_month", 'SELECT "user", category, item, date, use_per_month FROM active_use')
def use_per_month(spark, d):
    return active(spark, d).select(*KEYS, "use_per_month")


@query(
    "U6_carry_forward",
    'SELECT "user", category, item, date, used, active, cumuse, days_active FROM use',
)
def carry_forward(spark, d):
    return usage.carry_forward(active(spark, d), t.end(spark, d)).select(
        *KEYS, "used", "active", "cumuse", "days_active"
    )


@query(
    "U7_usage_table",
    """
SELECT u."user", u.category, u.item, date, used, active, u.price, cumuse, cost_per_use, days_active, use_per_month,
       plot_size, 'Photos/' || i.photo || '.png' AS photo
FROM use u JOIN items i ON u."user" = i."user" AND u.item = i.item
""",
)
def usage_table(spark, d):
    return t.use(spark, d, photos=True)


def refreshed(spark, d):
    """A usage table that was refreshed up to three days in turn."""
    folder = storage.scratch_path(spark, "increments")
    last = t.read(spark, d, "orders").agg(F.to_date(F.max("o_orderdate"))).first()[0]
    # Every refresh reads both, as it would read a diary and an item list that are kept.
    log, items = storage.materialised(t.log(spark, d), "log"), storage.materialised(t.items(spark, d), "items")
    for end in (dt.date(1999, 12, 31), dt.date(2001, 5, 31), last):
        increments.refresh(spark, folder, log, items, t.START, end)
    return folder


@query(
    "U7_incremental",
    """
SELECT "user", category, item, date, used, active, price, cumuse, cost_per_use, days_active, use_per_month, plot_size
FROM use
""",
)
def usage_by_refreshes(spark, d):
    return increments.usage(spark, refreshed(spark, d))


@query(
    "U8_latest_state",
    """
SELECT "user", category, item, active, cumuse, cost_per_use, days_active, use_per_month
FROM use WHERE date = (SELECT max(date) FROM use)
""",
)
def latest_state(spark, d):
    return cost_per_wear_today(t.use_today(spark, d), t.end(spark, d))


@query(
    "U9_thin_dates",
    """
SELECT "user", category, item, date, cumuse FROM use
WHERE date IN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS n
                                 FROM (SELECT DISTINCT date FROM use)) WHERE n % 2 = 1)
""",
)
def thin_dates(spark, d):
    return usage.thin_dates(t.saved_use(spark, d).select(*KEYS, "cumuse"))


@query(
    "check_log_gaps",
    """
SELECT DISTINCT u."user", u.item FROM use u JOIN items i ON u."user" = i."user" AND u.item = i.item
WHERE NOT u.active AND i.date_divested IS NULL
""",
)
def log_gaps(spark, d):
    return usage.log_gaps(t.use(spark, d), t.items(spark, d))
