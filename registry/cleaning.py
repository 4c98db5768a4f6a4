"""Cleaning, reshaping and dimension queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import tables as t
from registry.catalog import even, query
from registry.scans import event_sheet
from registry.usage import active, clipped
from wearlog.functions.scalars import item_label, label_category, label_item
from wearlog.operators import cleaning
from wearlog.operators.usage import carry_forward
from wearlog.sources.wide import clean_sheet, to_log

ITEM = ["user", "category", "item"]
SUBSET = [c for c in t.CATEGORIES if c != "STANDARD"]


@query("C1_unpivot_log", 'SELECT "user", category, item, date, used FROM shoe_log')
def unpivot_log(spark, d):
    return to_log(clean_sheet(event_sheet(spark, d)))


@query("C2_clip_to_ownership", 'SELECT "user", category, item, date, used FROM clipped')
def clip(spark, d):
    return clipped(spark, d)


@query(
    "C3_drop_placeholders",
    """SELECT "user", category, item, date, used FROM log WHERE item NOT IN ('ECONOMY/1', 'PROMO/5')""",
)
def placeholders(spark, d):
    return cleaning.drop_placeholders(t.log(spark, d), ("ECONOMY/1", "PROMO/5"))


@query(
    "C4_category_rank",
    """
SELECT "user", item, CASE WHEN category <> 'STANDARD' THEN category END AS category,
       CASE category WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4
                     WHEN 'SMALL' THEN 5 END AS rank
FROM items
""",
)
def category_rank(spark, d):
    return cleaning.with_category_rank(t.items(spark, d).select(*ITEM), t.dim(spark, SUBSET))


@query(
    "C5_category_changes",
    """
SELECT s."user", s.item, s.date_purchased, s.price,
       CASE WHEN c.target IS NULL THEN s.category WHEN c.target <> 'UNLISTED' THEN c.target END AS category
FROM study s LEFT JOIN (SELECT "user", item, arg_max(target_category, change_seq) AS target FROM changes
                        GROUP BY "user", item) c ON s."user" = c."user" AND s.item = c.item
""",
)
def category_changes(spark, d):
    study = t.study(spark, d).select(*ITEM, "date_purchased", "price")
    return cleaning.apply_category_changes(study, t.changes(spark, d), t.dim(spark))


@query(
    "C6_clean_study",
    """
SELECT "user", category, item, date_divested FROM study
WHERE NOT (category = 'SMALL' AND item LIKE '%#1%') AND category <> 'PROMO'
  AND (date_divested IS NULL OR date_divested >= DATE '2000-09-01')
""",
)
def clean_study(spark, d):
    rows = t.study(spark, d).select(*ITEM, "date_divested")
    return cleaning.clean_study(rows, t.STUDY_START, "#1", "SMALL", "PROMO")


@query(
    "C7_user_subsets",
    """
SELECT "user", category, item FROM study
WHERE "user" IN (SELECT "user" FROM users WHERE gender <> 'Other') AND "user" NOT IN ('U1', 'U3')
""",
)
def user_subsets(spark, d):
    chosen = t.users(spark, d).where("gender <> 'Other'")
    return cleaning.for_users(t.study(spark, d).select(*ITEM), include=chosen, exclude=["U1", "U3"])


@query(
    "C8_currency",
    f"""
SELECT s."user", category, item, {even('price * exchange_rate', 2)} AS price, {even('cpw * exchange_rate', 2)} AS cpw
FROM study s JOIN users u ON s."user" = u."user"
""",
)
def currency(spark, d):
    return cleaning.normalise_currency(t.study(spark, d).select(*ITEM, "price", "cpw"), t.users(spark, d))


@query(
    "C9_profiles",
    'SELECT s."user", category, item, gender, exchange_rate FROM study s JOIN users u ON s."user" = u."user"',
)
def profiles(spark, d):
    return cleaning.with_profile(t.study(spark, d).select(*ITEM), t.users(spark, d))


@query(
    "C10_photos",
    """
SELECT g."user", g.category, g.item, g.date, 'Photos/' || i.photo || '.png' AS photo
FROM log g LEFT JOIN items i ON g."user" = i."user" AND g.item = i.item
""",
)
def photos(spark, d):
    return cleaning.with_photo(t.log(spark, d).drop("used"), t.items(spark, d))


@query("C11_plot_size", 'SELECT "user", category, item, date, active, plot_size FROM use')
def plot_size(spark, d):
    use = carry_forward(active(spark, d), t.end(spark, d))
    return cleaning.with_plot_size(use).select(*ITEM, "date", "active", "plot_size")


def links(spark, d):
    pages = t.read(spark, d, "pages")
    return pages.select(
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("name"),
        F.col("url").alias("path"),
        F.concat(F.col("url"), F.lit("?dl=0")).alias("photo_url"),
    )


@query(
    "C12_links",
    """
SELECT DISTINCT 'page ' || CAST(page_id AS VARCHAR) AS item, url AS path, url || '?raw=1' AS photo_url
FROM pages WHERE contains(url, '1')
""",
)
def link_table(spark, d):
    found = links(spark, d)
    return cleaning.link_table(found.unionByName(found), "1")


@query(
    "C12_missing_links",
    "SELECT 'page ' || CAST(page_id AS VARCHAR) AS item, url AS path FROM pages WHERE NOT contains(url, '1')",
)
def missing_links(spark, d):
    listed = links(spark, d)
    files = listed.select(F.col("name").alias("item"), "path")
    return cleaning.missing_links(files, cleaning.link_table(listed, "1"))


@query(
    "C13_find_items",
    """SELECT "user", category, item FROM study WHERE item ILIKE '%brand#1%'""",
)
def find_items(spark, d):
    return cleaning.find_items(t.study(spark, d).select(*ITEM), "BRAND#1")


@query(
    "C14_labels",
    """SELECT "user", category || ' [' || item || ']' AS label, category, item FROM items""",
)
def labels(spark, d):
    labelled = t.items(spark, d).select("user", item_label("category", "item").alias("label"))
    return labelled.select("user", "label", label_category("label").alias("category"), label_item("label").alias("item"))


@query(
    "C15_union_fill",
    """
SELECT "user", category, item, price, NULL AS wears FROM items
UNION ALL SELECT "user", category, item, NULL, wears FROM study
""",
)
def union_fill(spark, d):
    return cleaning.union_fill(t.items(spark, d).select(*ITEM, "price"), t.study(spark, d).select(*ITEM, "wears"))


def step_extract(spark, d, types):
    return (
        t.event_days(spark, d)
        .where(F.col("item").isin(*types))
        .groupBy("user", F.date_format("date", "yyyy-MM-dd").alias("dateTime"))
        .agg(F.floor(F.max("value")).cast("string").alias("value"))
    )


@query(
    "C16_merge_steps",
    """
SELECT "user", date, coalesce(max(floor("value")) FILTER (WHERE item IN ('click', 'view')), max(floor("value"))) AS steps
FROM event_days GROUP BY "user", date
""",
)
def merge_steps(spark, d):
    first, second = ["click", "view"], ["error", "purchase", "signup"]
    return cleaning.merge_steps([step_extract(spark, d, first), step_extract(spark, d, second)], ["user"])


@query(
    "C17_intraday",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, "value" FROM events""",
)
def intraday(spark, d):
    raw = t.read(spark, d, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("dateTime"),
        F.date_format("ts", "HH:mm:ss").alias("dataset_time"),
        F.col("value").cast("string").alias("dataset_value"),
    )
    return cleaning.intraday(raw).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
