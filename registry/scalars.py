"""Row-level rules (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import tables as t
from registry.catalog import even, query
from wearlog.functions import numeric, scalars
from wearlog.operators.joins import join_null_safe
from wearlog.operators.usage import with_item_facts

ITEM = ["user", "category", "item"]


@query(
    "X1_cost_per_use",
    """
SELECT "user", category, item, wears, price, CASE WHEN wears = 0 THEN price ELSE price / wears END AS cost_per_use
FROM study
""",
)
def cost_per_use(spark, d):
    return t.study(spark, d).select(*ITEM, "wears", "price", scalars.cost_per_use("price", "wears").alias("cost_per_use"))


@query(
    "X2_days_before_start",
    """
SELECT "user", category, item, date_purchased,
       CASE WHEN date_purchased > DATE '1995-01-01' THEN 0 ELSE DATE '1995-01-01' - date_purchased END AS days_before
FROM items
""",
)
def days_before_start(spark, d):
    return t.items(spark, d).select(
        *ITEM, "date_purchased", scalars.days_before_start("date_purchased", t.START).alias("days_before")
    )


@query(
    "X3_day_increment",
    """
SELECT g."user", g.category, g.item, g.date,
       CASE WHEN g.date <> DATE '1995-01-01' THEN 1 WHEN i.date_purchased > DATE '1995-01-01' THEN 0
            ELSE DATE '1995-01-01' - i.date_purchased END AS increment
FROM log g JOIN items i ON g."user" = i."user" AND g.item = i.item
""",
)
def day_increment(spark, d):
    rows = with_item_facts(t.log(spark, d), t.items(spark, d))
    return rows.select(*ITEM, "date", scalars.day_increment("date", "date_purchased", t.START).alias("increment"))


@query(
    "X4_uses_per_month",
    """
SELECT "user", category, item,
       CASE WHEN months = 0 THEN 0 ELSE total_wears / (months * 31 / 30.5::DOUBLE) END AS use_per_month
FROM (SELECT *, (2000 - year(date_purchased)) * 12 + 9 - month(date_purchased) AS months FROM study)
""",
)
def uses_per_month(spark, d):
    days = scalars.calendar_months("date_purchased", t.STUDY_START) * 31
    return t.study(spark, d).select(*ITEM, scalars.uses_per_month("total_wears", days).alias("use_per_month"))


@query(
    "X5_calendar_months",
    """
SELECT "user", category, item, (2000 - year(date_purchased)) * 12 + 9 - month(date_purchased) AS months_available
FROM study
""",
)
def calendar_months(spark, d):
    return t.study(spark, d).select(
        *ITEM, scalars.calendar_months("date_purchased", t.STUDY_START).alias("months_available")
    )


@query(
    "X6_wardrobe_age",
    """
SELECT "user", category, item, least(greatest((DATE '1999-01-01' - date_purchased) / 365.0::DOUBLE, 0), 3) AS age
FROM study WHERE date_purchased IS NOT NULL
UNION ALL SELECT "user", category, item, NULL FROM study WHERE date_purchased IS NULL
""",
)
def wardrobe_age(spark, d):
    """Age on a day within the data and capped at 3 years, so that both limits occur."""
    asof = F.to_date(F.lit("1999-01-01"))
    return t.study(spark, d).select(*ITEM, scalars.age_years("date_purchased", asof, cap=3).alias("age"))


WEAR_TIER_SQL = """
CASE WHEN wears <= 0 THEN '0' WHEN wears <= 1 THEN '1' WHEN wears <= 2 THEN '2' WHEN wears <= 3 THEN '3'
     WHEN wears <= 5 THEN '4-5' WHEN wears <= 10 THEN '6-10' WHEN wears <= 20 THEN '11-20'
     WHEN wears <= 50 THEN '21-50' ELSE 'Over 50' END"""


@query("X7_wear_tier", f'SELECT "user", category, item, wears, {WEAR_TIER_SQL} AS tier FROM study')
def wear_tier(spark, d):
    return t.study(spark, d).select(*ITEM, "wears", scalars.wear_tier("wears").alias("tier"))


@query(
    "X8_age_tier",
    """
SELECT "user", category, item,
       CASE WHEN age <= 9 THEN CAST(greatest(ceil(age), 1) AS INTEGER)::VARCHAR WHEN age > 10 THEN 'Over 10' END AS tier,
       CASE WHEN age <= 10 THEN CAST(greatest(ceil(age), 1) AS INTEGER)::VARCHAR WHEN age > 10 THEN 'Over 10' END
         AS closed_tier
FROM (SELECT *, CASE WHEN date_purchased > DATE '2005-06-01' THEN 0
                     ELSE (DATE '2005-06-01' - date_purchased) / 365.0::DOUBLE END AS age FROM study)
""",
)
def age_tier(spark, d):
    """Tiers with the gap above nine years, and without it."""
    age = scalars.age_years("date_purchased", F.to_date(F.lit("2005-06-01")))
    return t.study(spark, d).select(
        *ITEM, scalars.age_tier(age).alias("tier"), scalars.age_tier(age, compat=False).alias("closed_tier")
    )


AGE_BAND_SQL = """
CASE WHEN days <= 365 THEN '< 1 year' WHEN days <= 730 THEN '1-2 years' WHEN days <= 1095 THEN '2-3 years'
     WHEN days > 1095 THEN '3+ years' END"""


@query(
    "X9_age_band",
    f"""
SELECT "user", category, item, {AGE_BAND_SQL} AS age_band
FROM (SELECT *, DATE '1997-01-01' - date_purchased AS days FROM study)
""",
)
def age_band(spark, d):
    days = F.datediff(F.to_date(F.lit("1997-01-01")), "date_purchased")
    return t.study(spark, d).select(*ITEM, scalars.age_band(days).alias("age_band"))


@query(
    "X10_effective_cost",
    """
SELECT * FROM (SELECT "user", category, item, price / CASE WHEN wears = 0 THEN 1 ELSE wears END AS cpw FROM study)
WHERE cpw > 0
""",
)
def effective_cost(spark, d):
    cost = numeric.ratio("price", scalars.effective_wears("wears")).alias("cpw")
    return t.study(spark, d).select(*ITEM, cost).where("cpw > 0")


@query(
    "X11_capped",
    'SELECT "user", category, item, CASE WHEN price > 150 THEN 150 ELSE price END AS price FROM study',
)
def capped(spark, d):
    return t.study(spark, d).select(*ITEM, numeric.capped("price", 150).alias("price"))


@query(
    "X12_worn_flags",
    """
SELECT "user", category, item, wears <> 0 AS worn, wears >= 4 AS worn_4, wears < 4 AS rarely_worn FROM study
""",
)
def worn_flags(spark, d):
    return t.study(spark, d).select(
        *ITEM,
        (F.col("wears") != 0).alias("worn"),
        scalars.worn_at_least("wears", 4).alias("worn_4"),
        (~scalars.worn_at_least("wears", 4)).alias("rarely_worn"),
    )


@query(
    "X13_study_flags",
    """
SELECT "user", category, item, date_purchased > DATE '2000-09-01' AS acquired, date_divested > DATE '2000-09-01' AS divested
FROM study
""",
)
def study_flags(spark, d):
    return t.study(spark, d).select(
        *ITEM,
        scalars.after("date_purchased", t.STUDY_START).alias("acquired"),
        scalars.after("date_divested", t.STUDY_START).alias("divested"),
    )


@query(
    "X14_web_names",
    """
SELECT i."user", i.category, i.item, replace(i.item, '/', '_') AS slug,
       'https://example.org/o/' || i.photo || '.png?alt=media' AS photo_url, lower(i.category) || '.html' AS url
FROM items i
""",
)
def web_names(spark, d):
    rows = t.items(spark, d).select(
        *ITEM,
        scalars.file_slug(F.replace("item", F.lit("/"), F.lit(" "))).alias("slug"),
        scalars.hosted_photo(F.concat(F.lit("Photos/"), F.col("photo"), F.lit(".png")), "https://example.org/o/").alias(
            "photo_url"
        ),
    )
    return join_null_safe(rows, t.dim(spark).select("category", "url"), ["category"], "left")


@query(
    "check_half_even_rounding",
    f"""
SELECT "user", category, item, {even('price / 8', 2)} AS eighths, {even('price / 2')} AS halves FROM study
""",
)
def half_even(spark, d):
    """Ties of all kinds, rounded to the even neighbour."""
    return t.study(spark, d).select(
        *ITEM,
        numeric.rounded(F.col("price") / 8, 2).alias("eighths"),
        numeric.rounded(F.col("price") / 2).alias("halves"),
    )
