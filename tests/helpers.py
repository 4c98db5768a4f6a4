"""Small tables for the unit tests; all values are invented."""

from __future__ import annotations

import datetime as dt



def day(n: int, month: int = 1, year: int = 2020) -> dt.date:
    return dt.date(year, month, n)




def make_log(spark, rows):
    """Rows of (item, date, used) for one user, all of category Shirts unless given."""
    full = [("me", r[3] if len(r) > 3 else "Shirts", r[0], r[1], r[2]) for r in rows]
    return spark.createDataFrame(full, "user string, category string, item string, date date, used boolean")


def make_items(spark, rows):
    """Rows of (item, price, purchased, divested, initial uses[, category])."""
    full = [("me", r[5] if len(r) > 5 else "Shirts", *r[:5]) for r in rows]
    return spark.createDataFrame(
        full,
        "user string, category string, item string, price double, date_purchased date, date_divested date, used_init double",
    )


STUDY = (
    "user string, category string, item string, wears double, price double, date_purchased date, date_divested date,"
    " secondhand boolean, total_wears double, washed double"
)


def make_study(spark, rows):
    """Dictionaries with any of the study columns."""
    names = [c.strip().split(" ")[0] for c in STUDY.split(",")]
    defaults = {"user": "u1", "category": "Shirts", "wears": 0.0}
    return spark.createDataFrame(
        [tuple({**defaults, "item": f"item {i:03d}", **r}.get(n) for n in names) for i, r in enumerate(rows)], STUDY
    )


def _key(row):
    return tuple((v is not None, f"{v:020.6f}" if isinstance(v, float) else str(v).rjust(20) if isinstance(v, int) else str(v)) for v in row)


def rows(df, *columns):
    """Sorted rows as tuples; nulls first."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=_key)


def one(df, *columns):
    found = rows(df, *columns)
    assert len(found) == 1
    return found[0]
