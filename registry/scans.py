"""Source and sink queries (S): tables go out to files in the shared folder and come back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry import tables as t
from registry.catalog import query
from wearlog import defaults
from wearlog.operators.wear_rate import estimate_changes
from wearlog.sources import storage, study, wide, workbook

ITEM = ["user", "category", "item"]


def _days(spark, d):
    """Every day from the first to the last one with an event."""
    first, last = t.event_days(spark, d).agg(F.min("date"), F.max("date")).first()
    return [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]


def event_sheet(spark, d, serial: bool = False):
    """Wide sheet of the event diary, as a user would keep it: one column per day."""
    days = _days(spark, d)
    if serial:
        headers = [str((day - wide.SERIAL_ORIGIN).days) for day in days]
        origin = F.lit(wide.SERIAL_ORIGIN)
        header, cell = F.datediff("date", origin).cast("string"), F.max(F.when(F.col("used"), "x"))
    else:
        headers = [day.strftime("%d.%m.%Y") for day in days]
        header, cell = F.date_format("date", "dd.MM.yyyy"), F.max("used")
    name = F.concat(F.col("item"), F.lit("\r\n"), F.col("user")) if serial else F.col("item")
    log = t.shoe_log(spark, d).select(
        F.col("category").alias("Category"), F.col("user").alias("User"), name.alias("Item"), header.alias("_h"),
        "date", "used",
    )
    return log.groupBy("Category", "User", "Item").pivot("_h", headers).agg(cell)


@query("S1_read_wide", 'SELECT "user", category, item, date, used FROM shoe_log')
def read_wide(spark, d):
    path = storage.scratch_path(spark, "sheet")
    storage.write_csv(event_sheet(spark, d), path)
    return wide.to_log(wide.read_wide(spark, path))


@query("S1_read_log", 'SELECT "user", category, item, date, used FROM shoe_log')
def read_log(spark, d):
    path = storage.scratch_path(spark, "sheet")
    storage.write_csv(event_sheet(spark, d), path)
    return wide.read_log(spark, path)


SERIAL_LOG = """
SELECT s."user", s.category, s.item || ' ' || s."user" AS item, CAST(s.date AS DATE) AS date,
       coalesce(g.used, FALSE) AS used
FROM (SELECT "user", category, item,
             unnest(generate_series((SELECT min(date) FROM event_days), (SELECT max(date) FROM event_days), INTERVAL 1 DAY)) AS date
      FROM shoe_items) s
LEFT JOIN shoe_log g ON s."user" = g."user" AND s.item = g.item AND CAST(s.date AS DATE) = g.date
"""


@query("S2_read_serial", SERIAL_LOG)
def read_serial(spark, d):
    path = storage.scratch_path(spark, "serial-sheet")
    storage.write_csv(event_sheet(spark, d, serial=True), path)
    return wide.to_log(wide.read_wide(spark, path, header="serial", multi_line=True))


@query("S2_read_workbook", SERIAL_LOG)
def read_workbook(spark, d):
    path = storage.scratch_path(spark, "workbooks")
    storage.save(workbook.pack(event_sheet(spark, d, serial=True)), path)
    return wide.to_log(wide.clean_sheet(workbook.sheet_table(storage.load(spark, path)), header="serial"))


STUDY_COLUMNS = ["user", "category", "item", "wears", "total_wears", "price", "date_purchased", "secondhand"]


@query(
    "S3_read_study",
    'SELECT "user", category, item, wears, total_wears, price, date_purchased, secondhand FROM study',
)
def read_study(spark, d):
    path = storage.scratch_path(spark, "study")
    storage.save(t.study_raw(spark, d), path)
    return study.read_study(spark, path).select(*STUDY_COLUMNS)


@query(
    "S4_read_open_study",
    """
SELECT "user", category, item, coalesce(wears, 0) AS wears, total_wears, price, listed_date AS date_purchased, secondhand
FROM study_raw
""",
)
def read_open_study(spark, d):
    path = storage.scratch_path(spark, "open-study")
    storage.write_csv(t.study_raw(spark, d), path)
    return study.read_study(spark, path, open_project=True, file_format="csv").select(*STUDY_COLUMNS)


@query("S5_read_users", 'SELECT "user", gender, exchange_rate FROM users')
def read_users(spark, d):
    profiles = t.users(spark, d)
    mark = profiles.agg(F.lit(defaults.END_OF_USER_LIST).alias("user"))
    path = storage.scratch_path(spark, "users")
    storage.save(profiles.unionByName(mark, allowMissingColumns=True), path)
    return study.read_users(spark, path)


@query(
    "S6_read_comparison",
    """
SELECT category AS "Category", 'Photos/' || category || '.png' AS photo, CAST(max(price) AS VARCHAR) AS "monthly cost",
       '0.25' AS "category use"
FROM items GROUP BY category
""",
)
def read_comparison(spark, d):
    path = storage.scratch_path(spark, "comparison")
    storage.write_csv(comparison(spark, d), path)
    return study.read_comparison(spark, path)


def comparison(spark, d):
    """External products: one per category, at the price of its dearest item."""
    return t.items(spark, d).groupBy("category").agg(F.max("price").alias("_price")).select(
        F.col("category").alias("Category"),
        F.concat(F.lit("Photos/"), F.col("category"), F.lit(".png")).alias("photo"),
        F.col("_price").cast("string").alias("monthly cost"),
        F.lit("0.25").alias("category use"),
    )


@query(
    "S7_saved_usage",
    'SELECT "user", category, item, date, used, active, cumuse, price FROM use',
)
def saved_usage(spark, d):
    use = t.use(spark, d).select(*ITEM, "date", "used", "active", "cumuse", "price")
    return storage.materialised(use, "usage")


@query(
    "S8_csv_export",
    'SELECT "user", category, count(*) AS items, coalesce(sum(price), 0) AS "value" FROM study GROUP BY "user", category',
)
def csv_export(spark, d):
    table = t.study(spark, d).groupBy("user", "category").agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("price"), F.lit(0.0)).alias("value")
    )
    path = storage.scratch_path(spark, "export")
    storage.write_csv(table, path)
    return storage.read_csv(spark, path, table.schema)


@query(
    "S9_snapshots",
    """
SELECT "user", category, item, date_purchased, total_wears, total_wears + 1 AS total_wears_orig,
       CAST(-1 AS DOUBLE) AS wears_change
FROM study WHERE repaired > 0 AND total_wears IS NOT NULL
""",
)
def snapshots(spark, d):
    """Two saved states of the study, of which the earlier one has other estimates for repaired items."""
    now = t.study(spark, d)
    before = now.withColumn(
        "total_wears", F.when(F.col("repaired") > 0, F.col("total_wears") + 1).otherwise(F.col("total_wears"))
    )
    paths = [storage.scratch_path(spark, name) for name in ("now", "before")]
    for table, path in zip((now, before), paths):
        storage.save(table, path)
    return estimate_changes(*[storage.read_snapshot(spark, path) for path in paths])
