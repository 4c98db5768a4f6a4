"""Whole reports, composed from the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog.operators.cleaning import apply_category_changes, clean_study, for_users, normalise_currency
from wearlog.operators.daily_cost import daily_cost
from wearlog.operators.listings import category_listing, item_listing
from wearlog.operators.portfolio import category_reports, divested_averages
from wearlog.operators.usage import latest, usage_table
from wearlog.sources.storage import materialised
from wearlog.sources.wide import sheet_items, sheet_range, to_log


def cost_per_wear_today(use: DataFrame, last: Column | dt.date | None = None) -> DataFrame:
    """Each item as of the last day, with its cost per wear so far."""
    return latest(use, last=last).select(
        "user",
        "category",
        "item",
        "active",
        "cumuse",
        "cost_per_use",
        "days_active",
        "use_per_month",
    )


def category_view(
    use: DataFrame, categories: Sequence[str], last: Column | dt.date | None = None
) -> DataFrame:
    """Latest state of the selected categories, as the interactive viewer asks for it."""
    return cost_per_wear_today(use.where(F.col("category").isin(*categories)), last)


def refresh(sheet: DataFrame, dim: DataFrame, start: Column | dt.date | None = None) -> dict[str, DataFrame]:
    """All tables of one diary sheet: usage, portfolio, daily cost and listings.

    The usage table is written once and read by every report; it is grouped by category and day once.
    """
    first, last = sheet_range(sheet)
    items = sheet_items(sheet)
    use = materialised(usage_table(to_log(sheet), items, start or first, last), "usage")
    reports = materialised(category_reports(use), "reports")
    return {
        "usage": use,
        "inventory": reports.where(F.col("itemcount") > 0).drop("cumuse", "category_value", "category_use", "daily_cost", "yearly_cost"),
        "use_to_date": reports.drop("itemcount", "categoryvalue", "category_used", "rolling_category_use", "category_turnaround"),
        "daily_cost": daily_cost(use),
        "divested_averages": divested_averages(use),
        "item_listing": item_listing(use, last),
        "category_listing": category_listing(reports, dim, last=last),
    }


def prepare_study_items(
    items: DataFrame,
    start: dt.date,
    dim: DataFrame,
    changes: DataFrame | None = None,
    users: DataFrame | None = None,
    exclude: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Study items ready for all summaries: currency, category changes, filters, users."""
    if users is not None:
        items = normalise_currency(items, users)
    if changes is not None:
        items = apply_category_changes(items, changes, dim)
    return for_users(clean_study(items, start), exclude=exclude)
