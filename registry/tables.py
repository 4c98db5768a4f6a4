"""Diary tables derived from the driver's order tables, in Spark and as SQL.

* Diary: a wardrobe belongs to 100 customers, an item is a part type with a size band, and
  an order line is an entry of its order day, used if the line was returned. The number of
  wardrobes grows with the data.
* Study: a participant stands for 20 customers, a category is a part type and an item a
  brand; quantities are wears.
* Steps: events of 30 days, where event types are shoes and event values steps.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearlog.functions.numeric import count_if
from wearlog.operators.usage import last_state, usage_table
from wearlog.schema import category_dim
from wearlog.sources.storage import materialised

START = dt.date(1995, 1, 1)
STUDY_START = dt.date(2000, 9, 1)
STUDY_END = dt.date(2001, 9, 1)
MONTHS = 12
STEPS_START = dt.date(2024, 1, 1)
STEPS_END = dt.date(2024, 1, 30)

# Fixed values of the driver tables.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
WAYS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SHOES = ["click", "error", "purchase", "signup", "view"]

# Order lines per task of a diary. A task sorts the days of its items and groups them, at about a kilobyte a line.
LINES_PER_PART = 100_000


_SCHEMAS: dict[str, T.StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a driver table; its footer is read once per table, not once per use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def dim(spark: SparkSession, order: list[str] | None = None) -> DataFrame:
    order = CATEGORIES if order is None else order
    return category_dim(spark, order, [f"{c.lower()}.html" for c in order], [f"Photos/{c}.png" for c in order])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ten times the lines of a diary's part: groupings behind the join sum more of them before they shuffle.
    n = parts(spark, sf_dir)
    n = max(n // 10, min(n, spark.sparkContext.defaultParallelism))
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_custkey",
        F.to_date("o_orderdate").alias("day"),
        "o_orderstatus",
        "o_orderpriority",
    )
    orders, entries = orders.repartition(n, "l_orderkey"), read(spark, sf_dir, "lineitem").repartition(n, "l_orderkey")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_size")
    return entries.join(orders, "l_orderkey").join(part, "l_partkey")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Number of parts of a diary, so that a part has the same size however long the diary is.

    The rows come from the file footers. Parts that follow from shuffled bytes instead grow with the
    data, as day rows compress far below what a task holds of them.
    """
    return read(spark, sf_dir, "lineitem").count() // LINES_PER_PART + 1


def _owner(prefix: str, key: str, size: int) -> Column:
    return F.concat(F.lit(prefix), F.floor(F.col(key) / F.lit(size)).cast("string"))


def diary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = (F.floor((F.col("p_size") - 1) / F.lit(10)) + 1).cast("string")
    return lines(spark, sf_dir).select(
        _owner("W", "o_custkey", 100).alias("user"),
        F.col("p_type").alias("category"),
        F.concat(F.col("p_type"), F.lit("/"), band).alias("item"),
        "day",
        "l_returnflag",
        "l_quantity",
        "p_size",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    start = F.lit(START)
    return (
        diary_lines(spark, sf_dir)
        .groupBy("user", "category", "item")
        .agg(
            F.when(n % 11 != 0, (F.sum("l_quantity").cast("long") % 200).cast("double")).alias("price"),
            F.when(n % 13 == 0, F.lit(None))
            .when(n % 3 == 0, F.date_sub(start, n.cast("int")))
            .when(n % 3 == 1, F.date_add(F.min("day"), 200))
            .otherwise(start)
            .alias("date_purchased"),
            F.when(n % 4 == 0, F.date_sub(F.max("day"), 400)).alias("date_divested"),
            F.when(n % 17 != 0, (F.min("p_size") % 5).cast("double")).alias("used_init"),
        )
        .withColumn("photo", F.col("item"))
        .repartition(parts(spark, sf_dir), "user", "item")
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the items, placed by user and item as the usage operators need them: one shuffle for all."""
    entries = diary_lines(spark, sf_dir).select(
        "user", "category", "item", F.col("day").alias("date"), (F.col("l_returnflag") == "R").alias("_returned")
    )
    placed = entries.repartition(parts(spark, sf_dir), "user", "item")
    return placed.groupBy("user", "category", "item", "date").agg(F.bool_or("_returned").alias("used"))


def end(spark: SparkSession, sf_dir: str) -> Column:
    """Last day of all diaries, as a one-row subquery."""
    return read(spark, sf_dir, "orders").select(F.to_date(F.max("o_orderdate"))).scalar()


def use(spark: SparkSession, sf_dir: str, photos: bool = False) -> DataFrame:
    return usage_table(log(spark, sf_dir), items(spark, sf_dir), START, end(spark, sf_dir), photos=photos)


def use_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of the usage table."""
    return last_state(log(spark, sf_dir), items(spark, sf_dir), START, end(spark, sf_dir), photos=False)


def saved_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage table on disk, for reports that read it more than once."""
    return materialised(use(spark, sf_dir), "usage")


def saved_use_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day on disk, for reports that read it more than once."""
    listed = materialised(items(spark, sf_dir), "items")
    return materialised(last_state(log(spark, sf_dir), listed, START, end(spark, sf_dir), photos=False), "today")


def study_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    in_study = F.col("day") > F.lit(STUDY_START)
    first_part, quantity = F.min("l_partkey"), F.col("l_quantity")
    price = F.when(n % 11 != 0, (F.sum(F.col("l_linenumber") * F.col("l_suppkey")) % 400).cast("double"))
    return (
        lines(spark, sf_dir)
        .groupBy(
            _owner("U", "o_custkey", 20).alias("user"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("item"),
        )
        .agg(
            F.sum(F.when(in_study, quantity)).alias("wears"),
            F.sum(F.when(~in_study, quantity)).alias("total_wears"),
            F.when(n % 9 != 0, count_if(in_study & (F.col("l_returnflag") == "R")).cast("double")).alias("washed"),
            price.alias("price"),
            (price / F.sum(quantity)).alias("cpw"),
            F.when(n % 7 != 0, F.min("day")).alias("date_purchased"),
            F.max("day").alias("listed_date"),
            F.when(n % 5 == 0, F.to_date(F.max("l_shipdate"))).alias("date_divested"),
            F.when(n % 12 != 0, first_part % 3 == 0).alias("secondhand"),
            F.concat(F.lit("type "), (first_part % 4).cast("string")).alias("secondhand_type"),
            F.min("o_orderpriority").alias("divestment_way"),
            F.max("o_orderstatus").alias("condition"),
            F.when(n % 9 != 0, count_if(in_study & (F.col("l_returnflag") == "A")).cast("double")).alias("repaired"),
            F.when(n % 8 != 0, F.max("l_linenumber") >= 6).alias("needs_repair"),
            F.when(n % 6 != 0, F.min("l_linenumber") == 1).alias("needs_repair_start"),
            F.min("o_orderstatus").alias("repair_kind"),
            F.max("o_orderpriority").alias("reason_not_repaired"),
            F.when(n % 4 != 0, F.min("l_linestatus")).alias("repair_willing_to_pay"),
            F.max("l_returnflag").alias("special_care_kind"),
            F.when(n % 9 != 0, F.min("l_suppkey") % 3 == 0).alias("sentimental_value"),
        )
    )


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_raw(spark, sf_dir).drop("listed_date").fillna({"wears": 0})


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.min("c_nationkey")
    return (
        read(spark, sf_dir, "customer")
        .groupBy(_owner("U", "c_custkey", 20).alias("user"))
        .agg(
            F.when(nation % 3 == 0, "Male").when(nation % 3 == 1, "Female").otherwise("Other").alias("gender"),
            (1 + nation / F.lit(64.0)).alias("exchange_rate"),
        )
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("l_orderkey") % 10 == 0, "UNLISTED").otherwise(F.col("p_type"))
    return (
        lines(spark, sf_dir).select(
            (F.col("l_orderkey") * 100000000 + F.col("l_partkey")).alias("change_seq"),
            _owner("U", "o_custkey", 20).alias("user"),
            F.col("p_brand").alias("item"),
            target.alias("target_category"),
        )
    )


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("user"),
        F.lit("Shoes").alias("category"),
        F.col("event_type").alias("item"),
        F.to_date("ts").alias("date"),
        F.col("user_id"),
        F.col("value"),
    )


def shoe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return (
        event_days(spark, sf_dir)
        .groupBy("user", "category", "item")
        .agg(
            (n % 50).cast("double").alias("price"),
            F.when(n % 2 == 0, F.date_sub(F.lit(STEPS_START), n.cast("int"))).otherwise(F.min("date")).alias("date_purchased"),
            F.when(n % 3 == 0, F.date_sub(F.max("date"), 5)).alias("date_divested"),
            (F.min("user_id") % 3).cast("double").alias("used_init"),
        )
    )


def shoe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_days(spark, sf_dir).groupBy("user", "category", "item", "date").agg(
        (F.max("value") >= 20).alias("used")
    )


def shoe_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_table(shoe_log(spark, sf_dir), shoe_items(spark, sf_dir), STEPS_START, STEPS_END, photos=False)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        event_days(spark, sf_dir)
        .groupBy("user", "date")
        .agg(F.sum(F.floor("value")).cast("double").alias("steps"))
    )


CTES: dict[str, str] = {
    "lines": """
SELECT l.*, o.o_custkey, CAST(o.o_orderdate AS DATE) AS day, o.o_orderstatus, o.o_orderpriority,
       p.p_type, p.p_brand, p.p_size
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
""",
    "bounds": "SELECT DATE '1995-01-01' AS day_one, max(CAST(o_orderdate AS DATE)) AS day_last FROM orders",
    "diary_lines": """
SELECT 'W' || CAST(o_custkey // 100 AS VARCHAR) AS "user", p_type AS category,
       p_type || '/' || CAST((p_size - 1) // 10 + 1 AS VARCHAR) AS item, day, l_returnflag, l_quantity, p_size
FROM lines
""",
    "items": """
SELECT "user", category, item,
       CASE WHEN count(*) % 11 <> 0 THEN CAST(CAST(sum(l_quantity) AS BIGINT) % 200 AS DOUBLE) END AS price,
       CASE WHEN count(*) % 13 = 0 THEN NULL
            WHEN count(*) % 3 = 0 THEN DATE '1995-01-01' - CAST(count(*) AS INTEGER)
            WHEN count(*) % 3 = 1 THEN min(day) + 200
            ELSE DATE '1995-01-01' END AS date_purchased,
       CASE WHEN count(*) % 4 = 0 THEN max(day) - 400 END AS date_divested,
       CASE WHEN count(*) % 17 <> 0 THEN CAST(min(p_size) % 5 AS DOUBLE) END AS used_init,
       item AS photo
FROM diary_lines GROUP BY "user", category, item
""",
    "log": """
SELECT "user", category, item, day AS date, bool_or(l_returnflag = 'R') AS used
FROM diary_lines GROUP BY "user", category, item, day
""",
    "clipped": """
SELECT g.*
FROM log g
LEFT JOIN (SELECT "user", item, max(date_purchased) AS bought, min(date_divested) AS gone
           FROM items GROUP BY "user", item) o ON g."user" = o."user" AND g.item = o.item
CROSS JOIN bounds b
WHERE g.date >= greatest(coalesce(o.bought, b.day_one), b.day_one)
  AND g.date <= least(coalesce(o.gone, b.day_last), b.day_last)
""",
    "facts": """
SELECT c.*, i.price, i.date_purchased, i.used_init
FROM clipped c JOIN items i ON c."user" = i."user" AND c.item = i.item
""",
    "cum": """
SELECT *, CASE WHEN cumuse = 0 THEN price ELSE price / cumuse END AS cost_per_use
FROM (SELECT *, sum(CAST(used AS INTEGER)) OVER (PARTITION BY "user", item ORDER BY date
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + used_init AS cumuse FROM facts)
""",
    "active_use": """
SELECT *, CASE WHEN days_active = 0 THEN 0 ELSE cumuse / (days_active / 30.5::DOUBLE) END AS use_per_month
FROM (
  SELECT *, CAST(CASE WHEN count(step) OVER so_far = count(*) OVER so_far THEN sum(step) OVER so_far END AS INTEGER)
            AS days_active
  FROM (SELECT *, CASE WHEN date <> DATE '1995-01-01' THEN 1 WHEN date_purchased > DATE '1995-01-01' THEN 0
                       ELSE DATE '1995-01-01' - date_purchased END AS step FROM cum)
  WINDOW so_far AS (PARTITION BY "user", item ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
""",
    "use": """
SELECT "user", category, item, date, used, price, cumuse, cost_per_use, days_active, use_per_month,
       TRUE AS active, 0.05::DOUBLE AS plot_size
FROM active_use
UNION ALL
SELECT "user", category, item,
       CAST(unnest(generate_series(date + 1, (SELECT day_last FROM bounds), INTERVAL 1 DAY)) AS DATE),
       FALSE, price, cumuse, cost_per_use, days_active, use_per_month, FALSE, 0.07::DOUBLE
FROM (SELECT * FROM active_use QUALIFY row_number() OVER (PARTITION BY "user", item ORDER BY date DESC) = 1)
WHERE date < (SELECT day_last FROM bounds)
""",
    "study_raw": """
SELECT 'U' || CAST(o_custkey // 20 AS VARCHAR) AS "user", p_type AS category, p_brand AS item,
       sum(CASE WHEN day > DATE '2000-09-01' THEN l_quantity END) AS wears,
       sum(CASE WHEN day <= DATE '2000-09-01' THEN l_quantity END) AS total_wears,
       CASE WHEN count(*) % 9 <> 0 THEN CAST(count(*) FILTER (WHERE day > DATE '2000-09-01' AND l_returnflag = 'R')
            AS DOUBLE) END AS washed,
       CASE WHEN count(*) % 11 <> 0 THEN CAST(sum(l_linenumber * l_suppkey) % 400 AS DOUBLE) END AS price,
       CASE WHEN count(*) % 11 <> 0 THEN CAST(sum(l_linenumber * l_suppkey) % 400 AS DOUBLE) END / sum(l_quantity)
            AS cpw,
       CASE WHEN count(*) % 7 <> 0 THEN min(day) END AS date_purchased,
       max(day) AS listed_date,
       CASE WHEN count(*) % 5 = 0 THEN CAST(max(l_shipdate) AS DATE) END AS date_divested,
       CASE WHEN count(*) % 12 <> 0 THEN min(l_partkey) % 3 = 0 END AS secondhand,
       'type ' || CAST(min(l_partkey) % 4 AS VARCHAR) AS secondhand_type,
       min(o_orderpriority) AS divestment_way,
       max(o_orderstatus) AS condition,
       CASE WHEN count(*) % 9 <> 0 THEN CAST(count(*) FILTER (WHERE day > DATE '2000-09-01' AND l_returnflag = 'A')
            AS DOUBLE) END AS repaired,
       CASE WHEN count(*) % 8 <> 0 THEN max(l_linenumber) >= 6 END AS needs_repair,
       CASE WHEN count(*) % 6 <> 0 THEN min(l_linenumber) = 1 END AS needs_repair_start,
       min(o_orderstatus) AS repair_kind,
       max(o_orderpriority) AS reason_not_repaired,
       CASE WHEN count(*) % 4 <> 0 THEN min(l_linestatus) END AS repair_willing_to_pay,
       max(l_returnflag) AS special_care_kind,
       CASE WHEN count(*) % 9 <> 0 THEN min(l_suppkey) % 3 = 0 END AS sentimental_value
FROM lines GROUP BY 1, 2, 3
""",
    "study": "SELECT * EXCLUDE (listed_date) REPLACE (coalesce(wears, 0) AS wears) FROM study_raw",
    "users": """
SELECT 'U' || CAST(c_custkey // 20 AS VARCHAR) AS "user",
       CASE min(c_nationkey) % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END AS gender,
       1 + min(c_nationkey) / 64.0::DOUBLE AS exchange_rate
FROM customer GROUP BY 1
""",
    "changes": """
SELECT l_orderkey * 100000000 + l_partkey AS change_seq, 'U' || CAST(o_custkey // 20 AS VARCHAR) AS "user",
       p_brand AS item, CASE WHEN l_orderkey % 10 = 0 THEN 'UNLISTED' ELSE p_type END AS target_category
FROM lines
""",
    "diary_cpw": """
SELECT * FROM (
  SELECT "user", category, item, price / CASE WHEN wears = 0 THEN 1 ELSE wears END AS cpw, wears AS plot_wears,
         price, secondhand FROM study) WHERE cpw > 0
""",
    "wpm": """
SELECT *, CASE WHEN wpm_real = 0 AND wpm_est > 0
               THEN CAST(round_even(CAST(CAST(wpm_est / 0.1::DOUBLE AS VARCHAR) AS DECIMAL(38, 17)), 1) AS DOUBLE)
               ELSE CAST(round_even(CAST(CAST(wpm_est / nullif(wpm_real, 0) AS VARCHAR) AS DECIMAL(38, 17)), 1) AS DOUBLE)
          END AS wpm_delta
FROM (
  SELECT "user", category, item, months_available, wears AS wears_real, total_wears AS wears_est,
         CAST(round_even(CAST(CAST(total_wears / months_available AS VARCHAR) AS DECIMAL(38, 17)), 1) AS DOUBLE) AS wpm_est,
         CAST(round_even(CAST(CAST(wears / 12.0::DOUBLE AS VARCHAR) AS DECIMAL(38, 17)), 1) AS DOUBLE) AS wpm_real,
         date_divested IS NOT NULL AS divested
  FROM (SELECT *, CAST((2000 - year(date_purchased)) * 12 + 9 - month(date_purchased) AS INTEGER) AS months_available
        FROM study WHERE total_wears IS NOT NULL)
  WHERE months_available > 0)
""",
    "event_days": """
SELECT 'E' || CAST(user_id AS VARCHAR) AS "user", 'Shoes' AS category, event_type AS item,
       CAST(ts AS DATE) AS date, user_id, "value"
FROM events
""",
    "shoe_items": """
SELECT "user", category, item, CAST(count(*) % 50 AS DOUBLE) AS price,
       CASE WHEN count(*) % 2 = 0 THEN DATE '2024-01-01' - CAST(count(*) AS INTEGER) ELSE min(date) END
           AS date_purchased,
       CASE WHEN count(*) % 3 = 0 THEN max(date) - 5 END AS date_divested,
       CAST(min(user_id) % 3 AS DOUBLE) AS used_init
FROM event_days GROUP BY "user", category, item
""",
    "shoe_log": """
SELECT "user", category, item, date, max("value") >= 20 AS used FROM event_days GROUP BY "user", category, item, date
""",
    "shoe_active": """
SELECT *, CAST(sum(step) OVER so_far AS INTEGER) AS days_active,
       sum(CAST(used AS INTEGER)) OVER so_far + used_init AS cumuse
FROM (
  SELECT g.*, i.used_init,
         CASE WHEN g.date <> DATE '2024-01-01' THEN 1 WHEN i.date_purchased > DATE '2024-01-01' THEN 0
              ELSE DATE '2024-01-01' - i.date_purchased END AS step
  FROM shoe_log g JOIN shoe_items i ON g."user" = i."user" AND g.item = i.item
  WHERE g.date >= greatest(i.date_purchased, DATE '2024-01-01')
    AND g.date <= least(coalesce(i.date_divested, DATE '2024-01-30'), DATE '2024-01-30'))
WINDOW so_far AS (PARTITION BY "user", item ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
    "shoe_use": """
SELECT "user", item, date, used, cumuse, days_active, TRUE AS active FROM shoe_active
UNION ALL
SELECT "user", item, CAST(unnest(generate_series(date + 1, DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE),
       FALSE, cumuse, days_active, FALSE
FROM (SELECT * FROM shoe_active QUALIFY row_number() OVER (PARTITION BY "user", item ORDER BY date DESC) = 1)
WHERE date < DATE '2024-01-30'
""",
    "steps": """
SELECT "user", date, sum(floor("value")) AS steps FROM event_days GROUP BY "user", date
""",
    "dim": """
SELECT * FROM (VALUES ('ECONOMY', 1), ('LARGE', 2), ('MEDIUM', 3), ('PROMO', 4), ('SMALL', 5), ('STANDARD', 6))
  AS t(category, rank)
""",
}
