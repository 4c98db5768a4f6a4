"""Wardrobe, secondhand, distribution and cost queries over the study table (W, K, B, G)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry import tables as t
from registry.catalog import even, query, safe_ratio, strict
from registry.scalars import AGE_BAND_SQL, WEAR_TIER_SQL
from wearlog.functions.scalars import age_years
from wearlog.operators import cost_per_wear as cpw
from wearlog.operators import distributions as dist
from wearlog.operators import secondhand as second
from wearlog.operators import study as ops

ITEM = ["user", "category", "item"]
START = "DATE '2000-09-01'"
PIVOT = ", ".join(f"""{{value}} FILTER (WHERE category = '{c}') AS "{c}\"""" for c in t.CATEGORIES)


def by_category(value: str) -> str:
    """SQL columns with an aggregate for each category."""
    return PIVOT.format(value=value)


def null_if_none(value: str) -> str:
    """SQL count columns that are null for empty cells."""
    return ", ".join(
        f"""nullif(count(*) FILTER (WHERE category = '{c}'{value}), 0) AS "{c}\"""" for c in t.CATEGORIES
    )


def rounded(table, digits, *columns):
    return table.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "W1_wardrobe_by_user",
    """
SELECT "user", count(*) AS items, round(avg(CAST(wears >= 1 AS INTEGER)), 9) AS share_worn, coalesce(sum(price), 0) AS "value"
FROM study WHERE date_divested IS NULL GROUP BY "user"
""",
)
def wardrobe_by_user(spark, d):
    return rounded(ops.wardrobe_by_user(t.study(spark, d)), 9, "share_worn")


@query(
    "W2_wardrobe_by_category",
    """
SELECT category, count(*) AS items, round(avg(CAST(wears >= 1 AS INTEGER)), 9) AS share_worn,
       coalesce(sum(price), 0) AS "value",
       round(count(*) / CAST((SELECT count(DISTINCT "user") FROM study) AS DOUBLE), 9) AS average_items,
       round(coalesce(sum(price), 0) / count(*), 9) AS average_value
FROM study WHERE date_divested IS NULL AND "user" NOT IN ('U0', 'U2') GROUP BY category
""",
)
def wardrobe_by_category(spark, d):
    table = ops.wardrobe_by_category(t.study(spark, d), exclude=["U0", "U2"])
    return rounded(table, 9, "share_worn", "average_items", "average_value")


@query(
    "W3_wardrobe_by_user_category",
    """
SELECT "user", category, count(*) AS items, coalesce(sum(price), 0) AS "value",
       round(coalesce(sum(price), 0) / count(*), 9) AS average_value
FROM study WHERE date_divested IS NULL GROUP BY "user", category
""",
)
def wardrobe_by_user_category(spark, d):
    return rounded(ops.wardrobe_by_user_category(t.study(spark, d)), 9, "average_value")


@query(
    "W4_start_matrix",
    f"""
SELECT "user", {null_if_none('')} FROM study WHERE date_purchased <= {START} OR date_purchased IS NULL GROUP BY "user"
""",
)
def start_matrix(spark, d):
    return ops.start_matrix(t.study(spark, d), t.STUDY_START, t.CATEGORIES)


CHANGE = f"""
count(*) - count(*) FILTER (WHERE date_purchased > {START}) AS items_at_start,
count(*) - count(*) FILTER (WHERE date_divested > {START}) AS items_at_end,
count(*) FILTER (WHERE date_purchased > {START}) AS new_items,
count(*) FILTER (WHERE date_divested > {START}) AS divested_items,
coalesce(sum(price), 0) - coalesce(sum(price) FILTER (WHERE date_purchased > {START}), 0) AS value_at_start,
coalesce(sum(price) FILTER (WHERE date_purchased > {START}), 0) AS value_new_items,
coalesce(sum(price) FILTER (WHERE date_divested > {START}), 0) AS value_divested_items,
coalesce(sum(price), 0) - coalesce(sum(price) FILTER (WHERE date_divested > {START}), 0) AS value_at_end
"""
CHANGE_BY_USER = f"""
WITH counted AS (SELECT "user", {CHANGE} FROM study GROUP BY "user"),
change AS (
  SELECT *, new_items - divested_items AS change,
         {even(safe_ratio('new_items - divested_items', 'items_at_start'), 2)} AS change_percent,
         {even(safe_ratio('new_items', 'items_at_start'), 2)} AS share_new,
         {even(safe_ratio('divested_items', 'items_at_start'), 2)} AS share_divested
  FROM counted)
"""


@query("W5_change_by_user_category", f'SELECT "user", category, {CHANGE} FROM study GROUP BY "user", category')
def change_by_user_category(spark, d):
    return ops.change_by_user_category(t.study(spark, d), t.STUDY_START)


@query(
    "W5_start_value_matrix",
    f"""
SELECT "user", {', '.join(f"""CASE WHEN count(*) FILTER (WHERE category = '{c}') > 0
  THEN coalesce(sum(price) FILTER (WHERE category = '{c}'), 0) END AS "{c}\"""" for c in t.CATEGORIES)}
FROM study WHERE date_purchased <= {START} OR date_purchased IS NULL GROUP BY "user"
""",
)
def start_value_matrix(spark, d):
    return ops.start_value_matrix(t.study(spark, d), t.STUDY_START, t.CATEGORIES)


@query("W6_change_by_user", CHANGE_BY_USER + "SELECT * FROM change")
def change_by_user(spark, d):
    return ops.change_by_user(t.study(spark, d), t.STUDY_START)


KEY_METRICS = f"""
metric AS (
  SELECT *, {even('"value" / items', 2)} AS avg_item_value
  FROM (SELECT "user", count(*) AS items, coalesce(sum(price), 0) AS "value" FROM study WHERE date_divested IS NULL
        GROUP BY "user")),
key_metric AS (
  SELECT "user", items, {even('(items - avg(items) OVER ()) / avg(items) OVER ()', 2)} AS items_delta, "value",
         {even('("value" - avg("value") OVER ()) / avg("value") OVER ()', 2)} AS value_delta, avg_item_value,
         {even('(avg_item_value - avg(avg_item_value) OVER ()) / avg(avg_item_value) OVER ()', 2)} AS avg_item_value_delta
  FROM metric)
"""
NET = f"""
net AS (
  SELECT "user", change AS net_new_items, change_percent AS items_change, value_at_end - value_at_start AS value_change,
         {even(safe_ratio('value_at_end - value_at_start', 'value_at_start'), 2)} AS value_change_percent
  FROM change)
"""


@query("W7_key_metrics", "WITH " + KEY_METRICS + "SELECT * FROM key_metric")
def key_metrics(spark, d):
    return ops.key_metrics(t.study(spark, d))


@query(
    "W8_wardrobe_metrics",
    CHANGE_BY_USER + "," + NET + "," + KEY_METRICS
    + 'SELECT k.*, n.* EXCLUDE ("user") FROM key_metric k JOIN net n ON k."user" = n."user"',
)
def wardrobe_metrics(spark, d):
    return ops.wardrobe_metrics(t.study(spark, d), t.STUDY_START)


@query(
    "W8_mean_metrics",
    CHANGE_BY_USER + "," + NET + "," + KEY_METRICS
    + """SELECT round(avg(items_change), 6) AS mean_items_change, round(avg(value_change), 6) AS mean_value_change,
       round((SELECT avg(avg_item_value) FROM key_metric), 6) AS mean_item_value FROM net""",
)
def mean_metrics(spark, d):
    table = ops.mean_metrics(t.study(spark, d), t.STUDY_START)
    return rounded(table, 6, "mean_items_change", "mean_value_change", "mean_item_value")


@query(
    "W9_price_variation",
    """
SELECT category, count(*) AS items, coalesce(sum(price), 0) AS "value", round(avg(price), 6) AS mean,
       round(stddev_samp(price), 6) AS sd, round(stddev_samp(price) / nullif(avg(price), 0), 6) AS coefficient_of_variation
FROM study WHERE date_divested IS NULL GROUP BY category
""",
)
def price_variation(spark, d):
    return rounded(ops.price_variation(t.study(spark, d)), 6, "mean", "sd", "coefficient_of_variation")


AT_START = f"(date_purchased <= {START} OR date_purchased IS NULL)"


@query(
    "W10_average_stock",
    f"""
SELECT {even(f'(count(*) FILTER (WHERE date_divested IS NULL) + count(*) FILTER (WHERE {AT_START})) / 2.0::DOUBLE')}
         AS total_items,
       {even(f'(sum(price) FILTER (WHERE date_divested IS NULL) + sum(price) FILTER (WHERE {AT_START})) / 2.0::DOUBLE')}
         AS total_value
FROM study
""",
)
def average_stock(spark, d):
    return ops.average_stock(t.study(spark, d), t.STUDY_START)


@query(
    "W11_new_value_share",
    f"""
SELECT round(sum(price) FILTER (WHERE date_purchased > {START}) / sum(price), 9) AS new_share,
       round(sum(price) / sum(price) FILTER (WHERE date_purchased > {START}), 9) AS years_to_renew
FROM study
""",
)
def new_value_share(spark, d):
    return rounded(ops.new_value_share(t.study(spark, d), t.STUDY_START), 9, "new_share", "years_to_renew")


@query(
    "W12_short_lived",
    f"""
SELECT "user", category, item, price, wears, secondhand, date_purchased, date_divested, divestment_way, condition,
       date_divested - date_purchased AS days_in_use
FROM study WHERE date_purchased >= {START} AND date_divested IS NOT NULL
""",
)
def short_lived(spark, d):
    columns = ["price", "wears", "secondhand", "date_purchased", "date_divested", "divestment_way", "condition"]
    return ops.short_lived(t.study(spark, d), t.STUDY_START).select(*ITEM, *columns, "days_in_use")


@query(
    "W13_valuable_items",
    """SELECT "user", category, item, price FROM study WHERE price >= 300 AND category IN ('PROMO', 'SMALL')""",
)
def valuable_items(spark, d):
    return ops.valuable_items(t.study(spark, d), 300, ["PROMO", "SMALL"])


@query(
    "W14_totals",
    """
SELECT count(*) AS items, coalesce(sum(price), 0) AS "value", count(*) - count(price) AS unknown_prices,
       count(DISTINCT "user") AS users, count(date_divested) AS divested_items
FROM study
""",
)
def totals(spark, d):
    return ops.totals(t.study(spark, d))


@query(
    "W14_largest_wardrobes",
    """
WITH sizes AS (SELECT "user", count(*) AS items, coalesce(sum(price), 0) AS "value" FROM study GROUP BY "user")
SELECT * FROM (SELECT 'items' AS largest_by, "user", items, "value" FROM sizes ORDER BY items DESC, "user" LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'value' AS largest_by, "user", items, "value" FROM sizes ORDER BY "value" DESC, "user" LIMIT 1)
""",
)
def largest_wardrobes(spark, d):
    return ops.largest_wardrobes(t.study(spark, d))


@query(
    "W14_gender_totals",
    """
SELECT gender, count(*) AS users, round(count(*) / CAST((SELECT count(*) FROM users) AS DOUBLE), 9) AS share
FROM users GROUP BY gender
""",
)
def gender_totals(spark, d):
    return rounded(ops.gender_totals(t.users(spark, d)), 9, "share")


@query(
    "W15_sentimental_share",
    f"""
SELECT *, {even('sentimental / CAST(items AS DOUBLE)', 2)} AS share_sentimental
FROM (SELECT "user", count(*) AS items, count(*) FILTER (WHERE sentimental_value) AS sentimental FROM study GROUP BY "user")
""",
)
def sentimental_share(spark, d):
    return ops.sentimental_share(t.study(spark, d))


def old_and_new(rows: str, whole: str | None, part: str, names: tuple[str, str], kind: str) -> str:
    columns = []
    for prefix, test in (("old", f"date_purchased <= {START}"), ("new", f"date_purchased > {START}")):
        n = f"count(*) FILTER (WHERE {test})"
        size = f"nullif({n}, 0)" if whole is None else f"sum({whole}) FILTER (WHERE {test})"
        known = f"count({part}) FILTER (WHERE {test})"
        columns += [
            f"{size} AS {prefix}_{names[0]}",
            f"CAST(CASE WHEN {known} = {n} THEN sum({part}) FILTER (WHERE {test}) END AS {kind}) AS {prefix}_{names[1]}",
        ]
    shares = [
        f"{even(safe_ratio(f'{p}_{names[1]}', f'{p}_{names[0]}'), 2)} AS {p}_share" for p in ("old", "new")
    ]
    return f"""
SELECT *, new_share - old_share AS share_change
FROM (SELECT *, {', '.join(shares)}
      FROM (SELECT "user", {', '.join(columns)} FROM {rows} WHERE date_purchased IS NOT NULL GROUP BY "user"))
"""


@query("K1_secondhand_share", old_and_new("study", None, "CAST(secondhand AS INTEGER)", ("items", "secondhand_items"), "BIGINT"))
def secondhand_share(spark, d):
    return second.secondhand_share(t.study(spark, d), t.STUDY_START)


VALUED = "(SELECT *, CAST(secondhand AS INTEGER) * price AS used_value FROM study WHERE secondhand IS NOT NULL AND price IS NOT NULL)"


@query("K2_secondhand_value_share", old_and_new(VALUED, "price", "used_value", ("value", "secondhand_value"), "DOUBLE"))
def secondhand_value_share(spark, d):
    return second.secondhand_value_share(t.study(spark, d), t.STUDY_START)


@query(
    "K3_secondhand_end",
    f"""
SELECT *, {even(safe_ratio('secondhand_value', '"value"'), 2)} AS secondhand_share
FROM (SELECT "user", count(*) AS items, CAST(sum(CAST(secondhand AS INTEGER)) AS BIGINT) AS secondhand_items, sum(price) AS "value",
             sum(used_value) AS secondhand_value
      FROM {VALUED} WHERE date_divested IS NULL GROUP BY "user")
""",
)
def secondhand_end(spark, d):
    return second.secondhand_end(t.study(spark, d))


@query(
    "K4_secondhand_items",
    'SELECT "user", category, item, price, secondhand_type, secondhand FROM study WHERE secondhand',
)
def secondhand_items(spark, d):
    return second.secondhand_items(t.study(spark, d))


@query(
    "K4_users_with_secondhand",
    'SELECT count(DISTINCT "user") AS users, count(*) AS items FROM study WHERE secondhand',
)
def users_with_secondhand(spark, d):
    return second.users_with_secondhand(t.study(spark, d))


@query(
    "K5_secondhand_by_user",
    f"""
SELECT *, {even(safe_ratio('secondhand', 'items'), 2)} AS share
FROM (SELECT "user", count(*) AS items, coalesce(sum(price), 0) AS "value",
             CAST({strict('CAST(secondhand AS INTEGER)')} AS BIGINT) AS secondhand FROM study GROUP BY "user")
""",
)
def secondhand_by_user(spark, d):
    return second.secondhand_by_user(t.study(spark, d)).orderBy(F.desc_nulls_last("share"), "user")


def gap_sql(measure: str) -> str:
    return f"""
SELECT *, {even(safe_ratio('used', '"new"'), 2)} AS gap
FROM (SELECT "user", category, {even(f'avg({measure}) FILTER (WHERE NOT secondhand)', 2)} AS "new",
             {even(f'avg({measure}) FILTER (WHERE secondhand)', 2)} AS used
      FROM study WHERE category NOT IN ('PROMO', 'Other') AND price > 0 GROUP BY "user", category)
WHERE "new" > 0 AND used > 0
"""


def gap(spark, d, measure):
    return second.secondhand_gap(t.study(spark, d), measure, exclude=("PROMO", "Other"))


@query("K6_secondhand_price_gap", gap_sql("price"))
def price_gap(spark, d):
    return gap(spark, d, "price")


def mean_gap_sql(measure: str) -> str:
    return f"""
SELECT category, count(*) AS users, {even('avg(CAST(gap AS DECIMAL(18, 2)))', 2)} AS avg_gap
FROM ({gap_sql(measure)}) GROUP BY category
"""


@query("K6_mean_price_gap", mean_gap_sql("price"))
def mean_price_gap(spark, d):
    return second.mean_gap(gap(spark, d, "price"))


@query("K7_secondhand_wear_gap", gap_sql("wears"))
def wear_gap(spark, d):
    return gap(spark, d, "wears")


@query("K7_mean_wear_gap", mean_gap_sql("wears"))
def mean_wear_gap(spark, d):
    return second.mean_gap(gap(spark, d, "wears"))


@query(
    "K8_secondhand_profile",
    """
SELECT category, secondhand, count(*) AS items, round(avg(plot_wears), 6) AS avg_wears, round(avg(price), 6) AS avg_price,
       round(avg(cpw), 6) AS avg_cpw
FROM diary_cpw GROUP BY category, secondhand
""",
)
def secondhand_profile(spark, d):
    table = second.secondhand_profile(cpw.cpw_diary(t.study(spark, d)))
    return rounded(table, 6, "avg_wears", "avg_price", "avg_cpw")


@query(
    "B1_share_worn",
    """
SELECT "user", category, count(*) AS items, round(avg(CAST(wears >= 1 AS INTEGER)), 9) AS share_worn
FROM study WHERE date_divested IS NULL GROUP BY "user", category
""",
)
def share_worn(spark, d):
    return rounded(dist.share_worn(t.study(spark, d)), 9, "share_worn")


@query(
    "B1_share_worn_below",
    """
SELECT "user", category, count(*) AS items, round(avg(CAST(wears < 4 AS INTEGER)), 9) AS share_worn
FROM study GROUP BY "user", category
""",
)
def share_worn_below(spark, d):
    return rounded(dist.share_worn(t.study(spark, d), 4, below=True, active_only=False), 9, "share_worn")


RARELY = f"""
SELECT *, {even('1 - worn_1 / CAST(items AS DOUBLE)', 2)} AS share_unworn,
       {even('1 - worn_n / CAST(items AS DOUBLE)', 2)} AS share_rarely_worn
FROM (SELECT "user", count(*) AS items, count(*) FILTER (WHERE wears >= 1) AS worn_1,
             count(*) FILTER (WHERE wears >= 4) AS worn_n FROM study WHERE category <> 'PROMO' GROUP BY "user")
"""


def rarely(spark, d):
    return dist.rarely_worn(t.study(spark, d), exclude=["PROMO"])


@query("B2_rarely_worn", RARELY)
def rarely_worn(spark, d):
    return rarely(spark, d)


@query(
    "B2_rarely_worn_overall",
    f"""
SELECT round(1 - sum(worn_1) / CAST(sum(items) AS DOUBLE), 9) AS share_unworn,
       round(1 - sum(worn_n) / CAST(sum(items) AS DOUBLE), 9) AS share_rarely_worn FROM ({RARELY})
""",
)
def rarely_worn_overall(spark, d):
    return rounded(dist.rarely_worn_overall(rarely(spark, d)), 9, "share_unworn", "share_rarely_worn")


@query(
    "B3_item_matrix",
    f'SELECT "user", {null_if_none("")} FROM study WHERE date_divested IS NULL GROUP BY "user"',
)
def item_matrix(spark, d):
    return ops.crosstab(t.study(spark, d).where(ops.NOT_DIVESTED), "user", "category", t.CATEGORIES)


@query(
    "B3_unworn_matrix",
    f'SELECT "user", {null_if_none("")} FROM study WHERE date_divested IS NULL AND wears = 0 GROUP BY "user"',
)
def unworn_matrix(spark, d):
    rows = t.study(spark, d).where(ops.NOT_DIVESTED).where("wears = 0")
    return ops.crosstab(rows, "user", "category", t.CATEGORIES)


@query("B3_wears_matrix", f"SELECT wears, {null_if_none('')} FROM study GROUP BY wears")
def wears_matrix(spark, d):
    return ops.crosstab(t.study(spark, d), "wears", "category", t.CATEGORIES)


@query("B3_total_wears_matrix", f"""SELECT "user", {by_category('sum(wears)')} FROM study GROUP BY "user\"""")
def total_wears_matrix(spark, d):
    return ops.crosstab(t.study(spark, d), "user", "category", t.CATEGORIES, F.sum("wears"))


TIER_RANK = """CASE tier WHEN '0' THEN 1 WHEN '1' THEN 2 WHEN '2' THEN 3 WHEN '3' THEN 4 WHEN '4-5' THEN 5
WHEN '6-10' THEN 6 WHEN '11-20' THEN 7 WHEN '21-50' THEN 8 ELSE 9 END"""


def tier_sql(keys: str, rows: str, rank: str) -> str:
    return f"""
SELECT {keys}, tier, tier_rank, items, CAST(sum(items) OVER w AS BIGINT) AS cum_items,
       round(items / CAST(sum(items) OVER g AS DOUBLE), 9) AS share,
       round(sum(items) OVER w / CAST(sum(items) OVER g AS DOUBLE), 9) AS cum_share
FROM (SELECT {keys}, tier, CAST({rank} AS INTEGER) AS tier_rank, count(*) AS items FROM ({rows})
      WHERE tier IS NOT NULL GROUP BY {keys}, tier)
WINDOW g AS (PARTITION BY {keys}), w AS (PARTITION BY {keys} ORDER BY tier_rank ROWS UNBOUNDED PRECEDING)
"""


WEAR_TIER_ROWS = f"SELECT category, {WEAR_TIER_SQL} AS tier FROM study"


@query("B4_wear_tiers", tier_sql("category", WEAR_TIER_ROWS, TIER_RANK))
def wear_tiers(spark, d):
    return rounded(dist.wear_tiers(t.study(spark, d)), 9, "share", "cum_share")


@query(
    "B4_wear_tier_matrix",
    f"SELECT tier, CAST({TIER_RANK} AS INTEGER) AS tier_rank, {null_if_none('')} FROM ({WEAR_TIER_ROWS}) GROUP BY tier",
)
def wear_tier_matrix(spark, d):
    return dist.wear_tier_matrix(t.study(spark, d), t.CATEGORIES)


ASOF = dt.date(2005, 6, 1)
AGE_ROWS = """
SELECT "user", category, CASE WHEN age <= 9 THEN CAST(greatest(ceil(age), 1) AS INTEGER)::VARCHAR
                              WHEN age > 10 THEN 'Over 10' END AS tier
FROM (SELECT *, greatest((DATE '2005-06-01' - date_purchased) / 365.0::DOUBLE, 0) AS age
      FROM study WHERE date_purchased IS NOT NULL AND date_divested IS NULL)
"""
AGE_RANK = "CASE WHEN tier = 'Over 10' THEN 10 ELSE CAST(left(tier, 1) AS INTEGER) END"


@query("B5_age_tiers", tier_sql("category", AGE_ROWS, AGE_RANK))
def age_tiers(spark, d):
    return rounded(dist.age_tiers(t.study(spark, d), ASOF), 9, "share", "cum_share")


@query("B5_age_tiers_by_user", tier_sql('"user", category', AGE_ROWS, AGE_RANK))
def age_tiers_by_user(spark, d):
    return rounded(dist.age_tiers(t.study(spark, d), ASOF, by_user=True), 9, "share", "cum_share")


@query(
    "B6_wears_price_by_age",
    f"""
SELECT "user", category, item, wears, price, {AGE_BAND_SQL} AS age_band
FROM (SELECT *, DATE '1997-01-01' - date_purchased AS days FROM study)
""",
)
def wears_price_by_age(spark, d):
    return dist.wears_price_by_age(t.study(spark, d), dt.date(1997, 1, 1))


@query(
    "B7_price_histogram",
    """
SELECT category, bin, count(*) AS items, bin * 10.0::DOUBLE AS bin_from, (bin + 1) * 10.0::DOUBLE AS bin_to
FROM (SELECT category, CAST(greatest(ceil(price / 10) - 1, 0) AS BIGINT) AS bin FROM study WHERE price BETWEEN 0 AND 360)
GROUP BY category, bin
""",
)
def price_histogram(spark, d):
    return dist.histogram(t.study(spark, d), "price", 10, 360)


@query(
    "B7_wears_histogram_centred",
    """
SELECT category, bin, count(*) AS items, (bin - 0.5::DOUBLE) * 5 AS bin_from, (bin + 0.5::DOUBLE) * 5 AS bin_to
FROM (SELECT category, CAST(ceil(wears / 5 - 0.5::DOUBLE) AS BIGINT) AS bin FROM study WHERE wears >= 0)
GROUP BY category, bin
""",
)
def wears_histogram(spark, d):
    return dist.histogram(t.study(spark, d), "wears", 5, centred=True)


def stats_sql(column: str, rows: str = "study") -> str:
    return f"""
SELECT category, count(*) AS items, round(avg({column}), 6) AS mean, max({column}) AS max,
       round(median({column}), 6) AS median
FROM {rows} GROUP BY category
"""


@query("B8_price_stats", stats_sql("price"))
def price_stats(spark, d):
    return rounded(dist.category_stats(t.study(spark, d), "price"), 6, "mean", "median")


@query("B8_wears_stats", stats_sql("wears"))
def wears_stats(spark, d):
    return rounded(dist.category_stats(t.study(spark, d), "wears"), 6, "mean", "median")


@query("B8_cpw_stats", stats_sql("cpw", "diary_cpw"))
def cpw_stats(spark, d):
    return rounded(dist.category_stats(cpw.cpw_diary(t.study(spark, d)), "cpw"), 6, "mean", "median")


@query(
    "B8_age_stats",
    stats_sql(
        "wardrobe_age",
        """(SELECT category, CASE WHEN date_purchased IS NOT NULL
                THEN least(greatest((DATE '2001-09-01' - date_purchased) / 365.0::DOUBLE, 0), 15) END AS wardrobe_age FROM study)""",
    ),
)
def age_stats(spark, d):
    aged = t.study(spark, d).withColumn("wardrobe_age", age_years("date_purchased", t.STUDY_END, cap=15))
    return rounded(dist.category_stats(aged, "wardrobe_age"), 6, "mean", "median")


def ranked_sql(column: str) -> str:
    return f"""
SELECT "user", category, item, least({column}, 150) AS {column},
       row_number() OVER (PARTITION BY "user", category ORDER BY {column} DESC NULLS LAST, item) AS index
FROM study WHERE {column} IS NOT NULL
UNION ALL
SELECT "user", category, item, NULL,
       row_number() OVER (PARTITION BY "user", category ORDER BY item)
       + (SELECT count(*) FROM study s WHERE s."user" = n."user" AND s.category = n.category AND s.{column} IS NOT NULL)
FROM study n WHERE {column} IS NULL
"""


@query("B9_ranked_wears", ranked_sql("wears"))
def ranked_wears(spark, d):
    return dist.ranked_items(t.study(spark, d), "wears")


@query("B9_ranked_prices", ranked_sql("price"))
def ranked_prices(spark, d):
    return dist.ranked_items(t.study(spark, d), "price")


@query(
    "B10_share_above",
    """
SELECT category, round(avg(CAST(wears > 40 AS INTEGER)), 9) AS share_above, count(*) FILTER (WHERE wears <= 5) AS few_wears
FROM study GROUP BY category
""",
)
def share_above(spark, d):
    return rounded(dist.share_above(t.study(spark, d), 40), 9, "share_above")


@query(
    "B11_wear_quantile",
    "SELECT category, round(quantile_cont(wears, 0.76), 6) AS quantile FROM study GROUP BY category",
)
def wear_quantile(spark, d):
    return rounded(dist.wear_quantile(t.study(spark, d), 0.76), 6, "quantile")


@query(
    "B12_top_items",
    """
SELECT "user", category, item, price, wears FROM study WHERE category = 'SMALL'
ORDER BY wears DESC NULLS LAST, "user", item LIMIT 30
""",
)
def top_items(spark, d):
    rows = t.study(spark, d).where("category = 'SMALL'").select(*ITEM, "price", "wears")
    return dist.top(rows, "wears", 30, ties=["user", "item"])


@query(
    "B12_bottom_items",
    """
SELECT "user", category, item, price, wears FROM study ORDER BY price ASC NULLS LAST, "user", category, item LIMIT 20
""",
)
def bottom_items(spark, d):
    return dist.top(t.study(spark, d).select(*ITEM, "price", "wears"), "price", 20, largest=False, ties=ITEM)


@query(
    "B12_top_groups",
    """
SELECT "user", category, count(*) AS items FROM diary_cpw GROUP BY "user", category
ORDER BY items DESC, "user", category LIMIT 40
""",
)
def top_groups(spark, d):
    return dist.top_groups(cpw.cpw_diary(t.study(spark, d)), ["user", "category"], 40)


@query(
    "G1_cpw_total",
    'SELECT "user", category, item, cpw, total_wears + wears AS plot_wears FROM study WHERE cpw > 0',
)
def cpw_total(spark, d):
    return cpw.cpw_total(t.study(spark, d))


@query("G2_cpw_diary", "SELECT * FROM diary_cpw")
def cpw_diary(spark, d):
    return cpw.cpw_diary(t.study(spark, d))


def segment_sql(bounds: dict[str, str]) -> str:
    shares = []
    for name, test in bounds.items():
        shares += [
            f"{even(f'count(*) FILTER (WHERE {test}) / CAST(count(*) AS DOUBLE)', 2)} AS share_items_{name}",
            f"{even(f'coalesce(sum(price) FILTER (WHERE {test}), 0) / sum(price)', 2)} AS share_value_{name}",
        ]
    return f'SELECT category, count(*) AS items, sum(price) AS "value", {", ".join(shares)} FROM diary_cpw GROUP BY category'


@query(
    "G3_wear_segments",
    segment_sql({"0_4": "plot_wears <= 4", "5_50": "plot_wears BETWEEN 5 AND 50", "51_up": "plot_wears >= 51"}),
)
def wear_segments(spark, d):
    return cpw.wear_segments(cpw.cpw_diary(t.study(spark, d)))


@query("G3_wear_segments_1_4", segment_sql({"1_4": "plot_wears BETWEEN 1 AND 4"}))
def wear_segments_worn(spark, d):
    return cpw.wear_segments(cpw.cpw_diary(t.study(spark, d)), {"1_4": (1, 4)})


@query(
    "G4_cpw_summary",
    f"""
SELECT category, count(*) AS items, sum(price) AS "value", {even('avg(plot_wears)')} AS wears_mean,
       {even('avg(cpw)', 2)} AS cpw_mean, {even('median(cpw)', 2)} AS cpw_median
FROM diary_cpw GROUP BY category
""",
)
def cpw_summary(spark, d):
    return cpw.cpw_summary(cpw.cpw_diary(t.study(spark, d)))


WASHES = f"""
SELECT "user", category, item, CASE WHEN washed = 0 AND wears > 0 THEN wears
                                    ELSE {even('wears / nullif(washed, 0)', 1)} END AS wears_per_wash
FROM study
"""
MEAN_WASHES = f"""
SELECT "user", category, {even('avg(CAST(wears_per_wash AS DECIMAL(18, 1)))', 1)} AS wears_per_wash
FROM ({WASHES}) GROUP BY "user", category
"""


@query("G5_wears_per_wash", WASHES)
def wears_per_wash(spark, d):
    return cpw.wears_per_wash(t.study(spark, d))


@query("G5_mean_wears_per_wash", MEAN_WASHES)
def mean_wears_per_wash(spark, d):
    return cpw.mean_wears_per_wash(cpw.wears_per_wash(t.study(spark, d)))


@query("G5_wears_per_wash_matrix", f"""SELECT "user", {by_category('max(wears_per_wash)')} FROM ({MEAN_WASHES}) GROUP BY "user\"""")
def wears_per_wash_matrix(spark, d):
    return cpw.wears_per_wash_matrix(t.study(spark, d), t.CATEGORIES)


AGES = f"""
SELECT "user", category, item, price, wears, round(cpw, 9) AS cpw, divestment_way, condition,
       {even('(date_divested - date_purchased) / 365.0::DOUBLE', 1)} AS wardrobe_age
FROM study WHERE date_divested > {START}
"""


@query("G6_divested_age", AGES)
def divested_age(spark, d):
    return rounded(cpw.divested_age(t.study(spark, d), t.STUDY_START), 9, "cpw")


@query(
    "G6_mean_divested_age",
    f"""
SELECT category, count(*) AS items, {even('avg(CAST(wardrobe_age AS DECIMAL(18, 1)))', 1)} AS avg_wardrobe_age_years
FROM ({AGES}) GROUP BY category
""",
)
def mean_divested_age(spark, d):
    return cpw.mean_divested_age(cpw.divested_age(t.study(spark, d), t.STUDY_START))
