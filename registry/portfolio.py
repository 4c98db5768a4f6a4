"""Category by date, daily cost, listing and step queries (P, D, L, H).

``PROMO`` plays the category that cost reports leave out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry import tables as t
from registry.catalog import even, query, safe_ratio, strict
from registry.scans import comparison
from wearlog.operators import daily_cost as cost
from wearlog.operators import listings, portfolio, steps, tails
from wearlog.operators.cleaning import with_category_rank
from wearlog.operators.usage import latest
from wearlog.plans.reports import category_view

DAYS = ["user", "category", "date"]
LEFT_OUT = ("PROMO",)


def report_days(spark, d):
    """The first day of every month of the diary, up to its last day."""
    months = F.sequence(F.lit(t.START), t.end(spark, d), F.expr("interval 1 month"))
    return spark.range(1, numPartitions=1).select(F.explode(months).alias("day"))


def stock(spark, d):
    """Inventory; the derived log has one row per item and day."""
    return portfolio.inventory(t.use(spark, d), one_row_per_day=True)


def spans(spark, d):
    """The usage table with one row for the frozen rest of an item."""
    return tails.usage_spans(t.log(spark, d), t.items(spark, d), t.START, t.end(spark, d))


STOCK = """
WITH days AS (
  SELECT "user", category, date, count(DISTINCT CASE WHEN active THEN item END) AS itemcount,
         CASE WHEN count(*) FILTER (WHERE active AND price IS NULL) = 0 THEN sum(price) FILTER (WHERE active) END
           AS categoryvalue,
         bool_or(used) AS category_used
  FROM use GROUP BY "user", category, date),
rolled AS (
  SELECT *, CASE WHEN count(*) OVER w = 30 THEN sum(CAST(category_used AS INTEGER)) OVER w / 30.0::DOUBLE END
            AS rolling_category_use
  FROM days WINDOW w AS (PARTITION BY "user", category ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
stock AS (
  SELECT *, rolling_category_use * 30 / itemcount AS category_turnaround FROM rolled WHERE itemcount > 0)
"""

TO_DATE = """
WITH days AS (
  SELECT "user", category, date, bool_or(used) AS category_used, coalesce(sum(cumuse), 0) AS cumuse,
         coalesce(sum(price), 0) AS category_value
  FROM use GROUP BY "user", category, date),
shared AS (
  SELECT *, sum(CAST(category_used AS INTEGER)) OVER w / CAST(date - min(date) OVER w + 1 AS DOUBLE) AS category_use
  FROM days WINDOW w AS (PARTITION BY "user", category ORDER BY date ROWS UNBOUNDED PRECEDING)),
to_date AS (
  SELECT *, daily_cost * 365 * category_use AS yearly_cost
  FROM (SELECT *, category_value / nullif(cumuse, 0) AS daily_cost FROM shared))
"""


@query(
    "P1_active_items",
    """
SELECT "user", category, date, count(DISTINCT item) AS itemcount FROM use WHERE active GROUP BY "user", category, date
""",
)
def active_items(spark, d):
    return portfolio.active_items(t.use(spark, d))


@query(
    "P2_active_value",
    f"""
SELECT "user", category, date, {strict('price')} AS categoryvalue FROM use WHERE active GROUP BY "user", category, date
""",
)
def active_value(spark, d):
    return portfolio.active_value(portfolio.with_price(t.use(spark, d), t.items(spark, d)))


@query("P3_rolling_category_use", STOCK + 'SELECT "user", category, date, category_used, rolling_category_use FROM rolled')
def rolling_use(spark, d):
    return portfolio.rolling_category_use(t.use(spark, d))


@query("P4_category_turnaround", STOCK + 'SELECT "user", category, date, round(category_turnaround, 9) AS category_turnaround FROM stock')
def turnaround(spark, d):
    return stock(spark, d).select(*DAYS, F.round("category_turnaround", 9).alias("category_turnaround"))


@query(
    "P5_inventory",
    STOCK
    + """SELECT "user", category, date, itemcount, categoryvalue, category_used, rolling_category_use,
       round(category_turnaround, 9) AS category_turnaround FROM stock""",
)
def inventory(spark, d):
    return stock(spark, d).withColumn("category_turnaround", F.round("category_turnaround", 9))


@query(
    "P5_from_intervals",
    STOCK
    + """SELECT "user", category, date, itemcount, categoryvalue, category_used, rolling_category_use,
       round(category_turnaround, 9) AS category_turnaround FROM stock""",
)
def inventory_from_intervals(spark, d):
    stock = tails.inventory(spans(spark, d), t.end(spark, d), one_row_per_day=True)
    return stock.withColumn("category_turnaround", F.round("category_turnaround", 9))


def to_date(spark, d):
    return portfolio.use_to_date(t.use(spark, d))


def to_date_from_intervals(spark, d):
    return tails.use_to_date(spans(spark, d), t.end(spark, d))


@query("P6_from_intervals", TO_DATE + 'SELECT "user", category, date, cumuse, category_value FROM to_date')
def use_from_intervals(spark, d):
    return to_date_from_intervals(spark, d).select(*DAYS, "cumuse", "category_value")


@query(
    "P9_from_intervals",
    TO_DATE
    + """SELECT "user", category, date, round(yearly_cost, 6) AS yearly_cost, round(yearly_cost / 12, 6) AS monthly_cost
FROM to_date""",
)
def cost_from_intervals(spark, d):
    table = portfolio.with_monthly_cost(to_date_from_intervals(spark, d))
    return table.select(*DAYS, *[F.round(c, 6).alias(c) for c in ("yearly_cost", "monthly_cost")])


@query(
    "P12_from_intervals",
    f"""
SELECT "user", category, date, round({safe_ratio(strict('cumuse'), strict('days_active'))} * 30.5, 9) AS avg_use_per_month_divested,
       round({safe_ratio(strict('cost_per_use * cumuse'), strict('cumuse'))}, 9) AS avg_cost_per_use_divested
FROM use WHERE NOT active AND days_active >= 30 GROUP BY "user", category, date
""",
)
def means_from_intervals(spark, d):
    means = tails.divested_means(spans(spark, d), t.end(spark, d))
    return means.withColumns({c: F.round(c, 9) for c in means.columns if c.startswith("avg_")})


@query("P6_use_to_date", TO_DATE + 'SELECT "user", category, date, cumuse, category_value FROM to_date')
def use_to_date(spark, d):
    return to_date(spark, d).select(*DAYS, "cumuse", "category_value")


@query("P7_cost_per_wear_to_date", TO_DATE + 'SELECT "user", category, date, daily_cost FROM to_date')
def cost_to_date(spark, d):
    return to_date(spark, d).select(*DAYS, "daily_cost")


@query("P8_share_of_days_used", TO_DATE + 'SELECT "user", category, date, category_use FROM to_date')
def days_used(spark, d):
    return to_date(spark, d).select(*DAYS, "category_use")


@query(
    "P9_yearly_cost",
    TO_DATE
    + """SELECT "user", category, date, round(yearly_cost, 6) AS yearly_cost, round(yearly_cost / 12, 6) AS monthly_cost
FROM to_date""",
)
def yearly_cost(spark, d):
    table = portfolio.with_monthly_cost(to_date(spark, d))
    return table.select(*DAYS, *[F.round(c, 6).alias(c) for c in ("yearly_cost", "monthly_cost")])


@query(
    "P10_inventory_total",
    f"""
SELECT "user", date, {strict('price')} AS inventoryvalue FROM use WHERE active AND category <> 'PROMO'
GROUP BY "user", date
""",
)
def inventory_total(spark, d):
    return portfolio.inventory_total(t.use(spark, d), exclude=LEFT_OUT)


@query(
    "P11_category_photo",
    TO_DATE + """SELECT "user", category, date, cumuse, 'Photos/' || category || '.png' AS photo FROM to_date""",
)
def category_photo(spark, d):
    return portfolio.with_category_photo(to_date(spark, d), t.dim(spark)).select(*DAYS, "cumuse", "photo")


@query(
    "P12_divested_averages",
    f"""
WITH averages AS (
  SELECT "user", category, date,
         {strict('cumuse')} AS uses, {strict('days_active')} AS days, {strict('cost_per_use * cumuse')} AS cost
  FROM use WHERE NOT active AND days_active >= 30 GROUP BY "user", category, date)
SELECT u."user", u.category, u.item, u.date,
       CASE WHEN NOT u.active AND u.days_active >= 30
            THEN round(CAST(a.uses AS DOUBLE) / nullif(a.days, 0) * 30.5, 6) END AS avg_use_per_month_divested,
       CASE WHEN NOT u.active AND u.days_active >= 30 THEN round(a.cost / nullif(a.uses, 0), 6) END
         AS avg_cost_per_use_divested
FROM use u LEFT JOIN averages a ON u."user" = a."user" AND u.category = a.category AND u.date = a.date
""",
)
def divested_averages(spark, d):
    table = portfolio.divested_averages(t.saved_use(spark, d))
    return table.select(
        *DAYS, "item", *[F.round(c, 6).alias(c) for c in ("avg_use_per_month_divested", "avg_cost_per_use_divested")]
    )


@query(
    "P13_comparison",
    TO_DATE
    + """SELECT "user", category, round(category_use, 9) AS category_use, round(yearly_cost / 12, 6) AS monthly_cost,
       'Photos/' || category || '.png' AS photo, FALSE AS comparison, date
FROM to_date WHERE date = (SELECT max(date) FROM to_date)
UNION ALL
SELECT NULL, category, 0.25, round(max(price), 6), 'Photos/' || category || '.png', TRUE, (SELECT max(date) FROM to_date)
FROM items GROUP BY category""",
)
def compared(spark, d):
    last = portfolio.with_category_photo(latest(to_date(spark, d), last=t.end(spark, d)), t.dim(spark))
    table = portfolio.compare(last, comparison(spark, d))
    return table.withColumn("category_use", F.round("category_use", 9)).withColumn(
        "monthly_cost", F.round("monthly_cost", 6)
    )


def daily_sql(keys: str) -> str:
    return f"""
WITH kept AS (SELECT * FROM use WHERE category <> 'PROMO'),
state AS (
  SELECT "user", item, CASE WHEN count(cost_per_use) = count(*) THEN min(cost_per_use) END AS cost,
         bool_and(active) AS active
  FROM kept GROUP BY "user", item),
days AS (
  SELECT {keys}, k.date, {strict('s.cost')} AS daily_cost, bool_or(s.active) AS still_active
  FROM kept k JOIN state s ON k."user" = s."user" AND k.item = s.item WHERE k.used GROUP BY {keys}, k.date),
averaged AS (
  SELECT *, CASE WHEN count(daily_cost) OVER w = 30 THEN avg(daily_cost) OVER w END AS mean
  FROM days k WINDOW w AS (PARTITION BY {keys} ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""


ROUNDED_COST = ("daily_cost", "average_daily_cost")


def rounded_cost(table):
    return table.withColumns({c: F.round(c, 9) for c in ROUNDED_COST})


@query(
    "D1_daily_cost",
    daily_sql('k."user"') + 'SELECT "user", date, round(daily_cost, 9) AS daily_cost, still_active FROM days',
)
def daily_cost(spark, d):
    return rounded_cost(cost.daily_cost(t.saved_use(spark, d), exclude=LEFT_OUT)).drop("average_daily_cost")


@query(
    "D2_midpoint_average",
    daily_sql('k."user"')
    + """SELECT "user", date, round(daily_cost, 9) AS daily_cost, still_active,
       round(lead(mean, 15) OVER (PARTITION BY "user" ORDER BY date), 9) AS average_daily_cost FROM averaged""",
)
def midpoint_average(spark, d):
    return rounded_cost(cost.daily_cost(t.saved_use(spark, d), exclude=LEFT_OUT))


@query(
    "D3_daily_cost_by_category",
    daily_sql('k."user", k.category')
    + """SELECT "user", category, date, round(daily_cost, 9) AS daily_cost, still_active,
       round(lead(mean, 15) OVER (PARTITION BY "user", category ORDER BY date), 9) AS average_daily_cost FROM averaged""",
)
def daily_cost_by_category(spark, d):
    return rounded_cost(cost.daily_cost(t.saved_use(spark, d), exclude=LEFT_OUT, by_category=True))


ASOF = f"""
WITH report AS (SELECT CAST(unnest(generate_series(day_one, day_last, INTERVAL 1 MONTH)) AS DATE) AS day FROM bounds),
kept AS (SELECT * FROM use WHERE category <> 'PROMO'),
state AS (
  SELECT "user", item, day, CASE WHEN count(cost_per_use) = count(*) THEN min(cost_per_use) END AS cost,
         bool_and(active) AS active
  FROM kept JOIN report ON date <= day GROUP BY "user", item, day),
days AS (
  SELECT k."user", r.day, k.date, {strict('s.cost')} AS daily_cost, bool_or(s.active) AS still_active
  FROM kept k JOIN report r ON k.date <= r.day JOIN state s ON k."user" = s."user" AND k.item = s.item AND r.day = s.day
  WHERE k.used GROUP BY k."user", r.day, k.date),
averaged AS (
  SELECT *, CASE WHEN count(daily_cost) OVER w >= 1 THEN avg(daily_cost) OVER w END AS mean
  FROM days WINDOW w AS (PARTITION BY "user", day ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
shifted AS (
  SELECT "user", day, date, round(daily_cost, 9) AS daily_cost, still_active,
         round(lead(mean, 15) OVER (PARTITION BY "user", day ORDER BY date), 9) AS average_daily_cost FROM averaged)
"""


@query("D4_daily_cost_asof", ASOF + "SELECT * FROM shifted")
def daily_cost_asof(spark, d):
    """Daily cost as of the first day of each month."""
    return rounded_cost(cost.daily_cost_asof(t.use(spark, d), report_days(spark, d), exclude=LEFT_OUT, parts=t.parts(spark, d)))


@query(
    "D5_trimmed_days",
    ASOF
    + """SELECT * FROM shifted
WHERE day IN (SELECT day FROM (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM shifted)
                               WHERE day >= DATE '1995-01-01' + 29 AND day <= (SELECT day_last FROM bounds) - 30) WHERE n % 2 = 1)""",
)
def trimmed_days(spark, d):
    table = rounded_cost(cost.daily_cost_asof(t.use(spark, d), report_days(spark, d), exclude=LEFT_OUT, parts=t.parts(spark, d)))
    return cost.trim_days(table, t.START, t.end(spark, d), step=2)


@query(
    "L1_item_listing",
    f"""
SELECT "user", category, item, price, cumuse AS times_worn, {even('cost_per_use', 2)} AS cost_per_wear,
       {even('use_per_month', 1)} AS wears_per_month, {even('days_active / 30.5::DOUBLE')} AS months_active,
       CASE WHEN active THEN 'Active' ELSE 'Divested' END AS status,
       CASE category WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4
                     WHEN 'SMALL' THEN 5 ELSE 6 END AS rank
FROM use WHERE date = (SELECT max(date) FROM use)
""",
)
def item_listing(spark, d):
    ranked = with_category_rank(listings.item_listing(t.use_today(spark, d), t.end(spark, d)), t.dim(spark))
    return listings.item_listing_order(ranked)


LISTING = (
    STOCK
    + ","
    + TO_DATE.strip().removeprefix("WITH ").replace("days AS (", "all_days AS (").replace("FROM days WINDOW", "FROM all_days WINDOW")
    + f""",
rows_today AS (
  SELECT u."user", u.category, s.itemcount, s.categoryvalue, u.daily_cost, u.category_use, u.yearly_cost
  FROM to_date u JOIN stock s ON u."user" = s."user" AND u.category = s.category AND u.date = s.date
  WHERE u.date = (SELECT max(date) FROM to_date)),
with_total AS (
  SELECT * FROM rows_today UNION ALL
  SELECT "user", 'Total', CAST(sum(itemcount) AS BIGINT), {strict('categoryvalue')}, NULL, NULL, {strict('yearly_cost')}
  FROM rows_today GROUP BY "user")
"""
)
LISTING_ROW = f"""
SELECT "user", category, itemcount, categoryvalue, round(daily_cost, 6) AS daily_cost, round(category_use, 6) AS category_use,
       round(yearly_cost, 6) AS yearly_cost, round({safe_ratio('yearly_cost', 'categoryvalue')}, 6) AS turnover
"""


def listing(spark, d, totals):
    reports = portfolio.category_reports(t.use(spark, d), one_row_per_day=True)
    table = listings.category_listing(reports, t.dim(spark), totals, t.end(spark, d))
    return table.withColumns({c: F.round(c, 6) for c in ("daily_cost", "category_use", "yearly_cost", "turnover")})


@query("L2_category_listing", LISTING + LISTING_ROW + "FROM rows_today")
def category_listing(spark, d):
    return listing(spark, d, totals=False).drop("rank")


@query("L3_category_listing_totals", LISTING + LISTING_ROW + "FROM with_total")
def category_listing_totals(spark, d):
    return listing(spark, d, totals=True).orderBy("user", "rank").drop("rank")


BANDS = """
SELECT "user", category, date, round(quantile_cont(cumuse, 0.32), 6) AS std1_low,
       round(quantile_cont(cumuse, 0.68), 6) AS std1_high, round(quantile_cont(cumuse, 0.05), 6) AS std2_low,
       round(quantile_cont(cumuse, 0.95), 6) AS std2_high
FROM use WHERE NOT active AND cumuse IS NOT NULL GROUP BY "user", category, date
"""
BAND_COLUMNS = ("std1_low", "std1_high", "std2_low", "std2_high")


@query(
    "L4_times_used",
    f"""
SELECT u."user", u.category, u.date, u.item, u.cumuse, u.days_active, u.active,
       row_number() OVER (PARTITION BY u."user", u.category, u.date
                          ORDER BY u.active, u.days_active DESC NULLS LAST, u.item) AS rownumber,
       std1_low, std1_high, std2_low, std2_high
FROM use u LEFT JOIN ({BANDS}) b ON u."user" = b."user" AND u.category = b.category AND u.date = b.date
WHERE u.date = (SELECT max(date) FROM use)
""",
)
def times_used(spark, d):
    return listings.times_used(t.saved_use_today(spark, d), last_only=False).withColumns({c: F.round(c, 6) for c in BAND_COLUMNS})


@query(
    "L4_times_used_all_dates",
    f"""
SELECT u."user", u.category, u.date, u.item, u.cumuse, u.days_active, u.active,
       row_number() OVER (PARTITION BY u."user", u.category, u.date
                          ORDER BY u.active, u.days_active DESC NULLS LAST, u.item) AS rownumber,
       std1_low, std1_high, std2_low, std2_high
FROM use u LEFT JOIN ({BANDS}) b ON u."user" = b."user" AND u.category = b.category AND u.date = b.date
""",
)
def times_used_all_dates(spark, d):
    """The ranking of every date of the usage table."""
    ranked = listings.times_used(t.saved_use(spark, d), last_only=False)
    return ranked.withColumns({c: F.round(c, 6) for c in BAND_COLUMNS})


@query(
    "L4_times_used_pooled",
    f"""
SELECT u."user", u.category, u.date, u.item, u.cumuse, u.days_active, u.active,
       row_number() OVER (PARTITION BY u."user", u.date ORDER BY u.active, u.days_active DESC NULLS LAST, u.item) AS rownumber,
       std1_low, std1_high, std2_low, std2_high
FROM use u LEFT JOIN ({BANDS.replace('"user", category, date', '"user", date').replace("IS NOT NULL", "IS NOT NULL AND category IN ('SMALL', 'LARGE')")}) b
  ON u."user" = b."user" AND u.date = b.date
WHERE u.date = (SELECT max(date) FROM use) AND u.category IN ('SMALL', 'LARGE')
""",
)
def times_used_pooled(spark, d):
    """Two categories of a user ranked together."""
    ranked = listings.times_used(t.saved_use_today(spark, d), last_only=False, categories=["SMALL", "LARGE"], pooled=True)
    return ranked.withColumns({c: F.round(c, 6) for c in BAND_COLUMNS})


@query("L5_use_bands", BANDS)
def use_bands(spark, d):
    return listings.use_bands(t.use(spark, d)).withColumns({c: F.round(c, 6) for c in BAND_COLUMNS})


@query(
    "view_of_categories",
    """
SELECT "user", category, item, active, cumuse, cost_per_use, days_active, use_per_month
FROM use WHERE date = (SELECT max(date) FROM use WHERE category IN ('SMALL', 'LARGE')) AND category IN ('SMALL', 'LARGE')
""",
)
def selected_categories(spark, d):
    return category_view(t.use_today(spark, d), ["SMALL", "LARGE"], t.end(spark, d))


ALLOCATED = """
WITH worn AS (SELECT "user", date, greatest(sum(CAST(used AS INTEGER)), 1) AS worn FROM shoe_use GROUP BY "user", date),
allocated AS (
  SELECT u.*, s.steps * CAST(u.used AS INTEGER) / w.worn AS steps
  FROM shoe_use u JOIN steps s ON u."user" = s."user" AND u.date = s.date
  JOIN worn w ON u."user" = w."user" AND u.date = w.date),
cumulative AS (
  SELECT *, round(sum(steps) OVER (PARTITION BY "user", item ORDER BY date ROWS UNBOUNDED PRECEDING)
            + coalesce(round_even(avg(CASE WHEN steps > 0 THEN steps END) OVER item_days
                       * max(CASE WHEN date = DATE '2024-01-01' AND cumuse > 0 THEN cumuse END) OVER item_days, 0), 0), 6)
            AS cumsteps
  FROM allocated WINDOW item_days AS (PARTITION BY "user", item))
"""


def allocated(spark, d):
    return steps.allocate_steps(t.shoe_use(spark, d), t.steps(spark, d))


def cumulative(spark, d):
    table = steps.cumulative_steps(allocated(spark, d), t.STEPS_START)
    return table.withColumn("cumsteps", F.round("cumsteps", 6))


@query("H1_allocated_steps", ALLOCATED + 'SELECT "user", item, date, used, round(steps, 6) AS steps FROM allocated')
def allocated_steps(spark, d):
    return allocated(spark, d).select("user", "item", "date", "used", F.round("steps", 6).alias("steps"))


@query(
    "H2_running_steps",
    ALLOCATED
    + """SELECT "user", item, date, round(sum(steps) OVER (PARTITION BY "user", item ORDER BY date
                                      ROWS UNBOUNDED PRECEDING), 6) AS cumsteps
FROM allocated""",
)
def running_steps(spark, d):
    """Steps to date without an opening balance: a diary that starts before all its days."""
    table = steps.cumulative_steps(allocated(spark, d), dt.date(2023, 12, 31))
    return table.select("user", "item", "date", F.round("cumsteps", 6).alias("cumsteps"))


@query("H3_cumulative_steps", ALLOCATED + 'SELECT "user", item, date, cumsteps FROM cumulative')
def cumulative_steps(spark, d):
    return cumulative(spark, d).select("user", "item", "date", "cumsteps")


@query(
    "H4_total_steps",
    ALLOCATED
    + """SELECT "user", item, date, cumsteps, active,
       row_number() OVER (PARTITION BY "user" ORDER BY active, cumsteps DESC NULLS LAST, item) AS rownumber
FROM (SELECT "user", item, max(date) AS date, max(cumsteps) AS cumsteps, arg_max(active, date) AS active
      FROM cumulative GROUP BY "user", item)""",
)
def total_steps(spark, d):
    return steps.total_steps(cumulative(spark, d))
