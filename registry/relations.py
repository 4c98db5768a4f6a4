"""Wear rate, model, repair, divestment and co-wear queries (M, R, Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import tables as t
from registry.catalog import even, query, safe_ratio, strict
from registry.study import by_category, rounded
from wearlog.functions.scalars import item_label
from wearlog.operators import cowear, models, repairs
from wearlog.operators import distributions as dist
from wearlog.operators import study as ops
from wearlog.operators import wear_rate as rate
from wearlog.sources import storage, versions

START = "DATE '2000-09-01'"


def per_item(spark, d):
    return rate.wpm_items(t.study(spark, d), t.STUDY_START, t.MONTHS)


@query("M1_wpm_items", "SELECT * FROM wpm")
def wpm_items(spark, d):
    return per_item(spark, d)


def wpm_sql(digits: int, estimate: bool) -> str:
    delta = even(safe_ratio("est", "real"), digits)
    if estimate:
        delta = f"CASE WHEN real = 0 AND est > 0 THEN {even('est / 0.1::DOUBLE', 1)} ELSE {delta} END"
    return f"""
SELECT "user", category, wears_real, est, real, {delta} AS delta_to_real, {even('est / 30.5::DOUBLE', digits)} AS delta_to_max
FROM (SELECT "user", category, sum(wears_real) AS wears_real,
             CAST(sum(CAST(wpm_est AS DECIMAL(18, 1))) AS DOUBLE) AS est,
             CAST(sum(CAST(wpm_real AS DECIMAL(18, 1))) AS DOUBLE) AS real
      FROM wpm GROUP BY "user", category)
"""


WPM_CATEGORY = wpm_sql(1, True)


@query("M2_wpm_category", WPM_CATEGORY)
def wpm_category(spark, d):
    return rate.wpm_category(per_item(spark, d))


@query("M2_wpm_category_open", wpm_sql(2, False))
def wpm_category_open(spark, d):
    return rate.wpm_category(per_item(spark, d), on_zero="null", digits=2)


@query(
    "M3_wpm_means",
    f"""
SELECT category, round(avg(wears_real / 12), 6) AS avg_wpm_real, round(avg(delta_to_real), 6) AS avg_delta_to_real
FROM ({WPM_CATEGORY}) GROUP BY category
""",
)
def wpm_means(spark, d):
    rows = per_item(spark, d)
    return rounded(rate.wpm_means(rows, rate.wpm_category(rows)), 6, "avg_wpm_real", "avg_delta_to_real")


def matrix_query(measure):
    @query(f"M4_matrix_{measure}", f"""SELECT "user", {by_category(f'max({measure})')} FROM ({WPM_CATEGORY}) GROUP BY "user\"""")
    def matrix(spark, d):
        return rate.wpm_matrix(rate.wpm_category(per_item(spark, d)), measure, t.CATEGORIES)

    return matrix


for _measure in ("real", "delta_to_max", "delta_to_real"):
    matrix_query(_measure)

RANKED = """
SELECT "user", category, wears, row_number() OVER (PARTITION BY "user", category ORDER BY wears) AS i FROM {rows}
"""
GINI = """
2 * CAST(sum(i * wears) AS DOUBLE) / nullif(count(*) * CAST(sum(wears) AS DOUBLE), 0) - (count(*) + 1) / CAST(count(*) AS DOUBLE)
"""
ESTIMATED = RANKED.format(rows="study WHERE total_wears IS NOT NULL")
CATEGORY_WEARS = f"""
SELECT "user", category, total_wears, items, max_wears, category_potential, {even('gini', 2)} AS gini,
       {even(safe_ratio('total_wears', 'items'))} AS avg_wears,
       {even(safe_ratio('category_potential', 'total_wears'), 1)} AS supply_in_years
FROM (SELECT "user", category, sum(wears) AS total_wears, count(*) AS items, max(wears) AS max_wears,
             count(*) * max(wears) - sum(wears) AS category_potential,
             greatest(({GINI}) * (CAST(count(*) AS DOUBLE) / nullif(count(*) - 1, 0)), CASE WHEN sum(wears) > 0 AND count(*) > 1 THEN 0 END) AS gini
      FROM ({ESTIMATED}) GROUP BY "user", category)
"""


@query("M5_category_wears", CATEGORY_WEARS)
def category_wears(spark, d):
    return rate.category_wears(t.study(spark, d))


@query(
    "M6_gini_biased",
    f"""
SELECT "user", category, round(greatest({GINI}, CASE WHEN sum(wears) > 0 THEN 0 END), 9) AS gini
FROM ({RANKED.format(rows='study')}) GROUP BY "user", category
""",
)
def gini_biased(spark, d):
    return rounded(rate.wear_gini(t.study(spark, d)), 9, "gini")


@query(
    "M7_category_wpm",
    f"""
SELECT "user", {by_category('max(rate)')}
FROM (SELECT *, {even('total_wears / 12', 1)} AS rate FROM ({CATEGORY_WEARS})) GROUP BY "user"
""",
)
def category_wpm(spark, d):
    return rate.category_wpm(rate.category_wears(t.study(spark, d)), t.CATEGORIES, t.MONTHS)


@query(
    "M7_mean_category_wpm",
    f"""
SELECT category, round(CAST(avg(CAST(rate AS DECIMAL(18, 1))) AS DOUBLE), 4) AS mean_category_wpm
FROM (SELECT *, {even('total_wears / 12', 1)} AS rate FROM ({CATEGORY_WEARS})) GROUP BY category
""",
)
def mean_category_wpm(spark, d):
    return rounded(rate.mean_category_wpm(rate.category_wears(t.study(spark, d)), t.MONTHS), 4, "mean_category_wpm")


@query(
    "M7_mean_category_wears",
    f"""
SELECT category, {even('avg(total_wears)')} AS avg_total_wears, {even('avg(avg_wears)')} AS avg_wears,
       {even('avg(max_wears)')} AS avg_max_wears, {even('avg(category_potential)')} AS avg_category_potential,
       {even('avg(CAST(supply_in_years AS DECIMAL(18, 1)))', 1)} AS avg_supply_in_years
FROM ({CATEGORY_WEARS}) GROUP BY category
""",
)
def mean_category_wears(spark, d):
    return rate.mean_category_wears(rate.category_wears(t.study(spark, d)))


@query(
    "M8_estimate_changes",
    """
SELECT "user", category, item, date_purchased, total_wears, total_wears - washed AS total_wears_orig, washed AS wears_change
FROM study WHERE total_wears IS NOT NULL AND washed > 0
""",
)
def estimate_changes(spark, d):
    """An earlier state in which the estimates were lower by the washes since."""
    now = t.study(spark, d)
    before = now.withColumn("total_wears", F.col("total_wears") - F.col("washed"))
    return rate.estimate_changes(now, before)


@query(
    "M8_changes_between_versions",
    """
SELECT "user", category, item, date_purchased, total_wears, total_wears + 2 AS total_wears_orig,
       CAST(-2 AS DOUBLE) AS wears_change
FROM study WHERE total_wears IS NOT NULL AND EXTRACT(YEAR FROM date_purchased) % 2 = 0
""",
)
def changes_between_versions(spark, d):
    """Two versions by year of purchase, of which the earlier one has other estimates for even years."""
    now = storage.materialised(t.study(spark, d), "study")  # each version reads it twice
    raised = F.when(F.year("date_purchased") % 2 == 0, F.col("total_wears") + 2).otherwise(F.col("total_wears"))
    folder = storage.scratch_path(spark, "versions")
    period = versions.by_year("date_purchased")
    numbers = [versions.write_version(table, folder, period) for table in (now.withColumn("total_wears", raised), now)]
    then, now = versions.read_changed(spark, folder, *numbers)
    return rate.estimate_changes(now, then)


def fit_sql(y: str, x: str, by: str, rows: str) -> str:
    group = f"{by}, " if by else ""
    sse = f"greatest(regr_syy({y}, {x}) - regr_slope({y}, {x}) * regr_sxy({y}, {x}), 0)"
    return f"""
WITH fit AS (
  SELECT {group}CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept,
         regr_r2({y}, {x}) AS r2, regr_avgx({y}, {x}) AS mx, regr_sxx({y}, {x}) AS sxx, {sse} AS sse,
         CASE WHEN regr_count({y}, {x}) > 2 THEN regr_count({y}, {x}) - 2 END AS freedom
  FROM {rows} {'GROUP BY ' + by if by else ''}),
errors AS (
  SELECT *, sqrt(sse / freedom / nullif(sxx, 0)) AS slope_se, sqrt(sse / freedom * (1.0::DOUBLE / nullif(n, 0) + mx * mx / nullif(sxx, 0))) AS intercept_se
  FROM fit)
SELECT {group}n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2,
       round(slope_se, 6) AS slope_se, round(intercept_se, 6) AS intercept_se, round(slope / nullif(slope_se, 0), 6) AS slope_t,
       round(intercept / nullif(intercept_se, 0), 6) AS intercept_t
FROM errors
"""


FIT_COLUMNS = ("slope", "intercept", "r2", "slope_se", "intercept_se", "slope_t", "intercept_t")


@query("R1_wears_by_price", fit_sql("wears", "price", "category", "study"))
def wears_by_price(spark, d):
    return rounded(models.linear_fit(t.study(spark, d), "wears", "price", ["category"]), 6, *FIT_COLUMNS)


@query(
    "R1_value_by_items",
    fit_sql(
        "worth",
        "items",
        "gender",
        """(SELECT u.gender, count(*) AS items, coalesce(sum(price), 0) AS worth FROM study s
JOIN users u ON s."user" = u."user" WHERE date_divested IS NULL GROUP BY s."user", u.gender)""",
    )
)
def value_by_items(spark, d):
    """Wardrobe value by number of items, one model per gender."""
    wardrobes = ops.wardrobe_by_user(t.study(spark, d)).join(t.users(spark, d), "user")
    return rounded(models.linear_fit(wardrobes, "value", "items", ["gender"]), 6, *FIT_COLUMNS)


@query(
    "R1_share_worn_by_items",
    fit_sql(
        "share_worn",
        "items",
        "category",
        """(SELECT category, count(*) AS items, avg(CAST(wears < 4 AS INTEGER)) AS share_worn FROM study
WHERE date_divested IS NULL GROUP BY "user", category)""",
    )
)
def share_worn_by_items(spark, d):
    shares = dist.share_worn(t.study(spark, d), 4, below=True)
    return rounded(models.linear_fit(shares, "share_worn", "items", ["category"]), 6, *FIT_COLUMNS)


@query(
    "R1_coefficient_table",
    """
WITH fit AS (
  SELECT regr_count(wears, price) AS n, regr_slope(wears, price) AS slope, regr_intercept(wears, price) AS intercept,
         regr_avgx(wears, price) AS mx, regr_sxx(wears, price) AS sxx,
         regr_syy(wears, price) - regr_slope(wears, price) * regr_sxy(wears, price) AS sse
  FROM study WHERE category = 'SMALL'),
errors AS (SELECT *, sqrt(sse / (n - 2) / sxx) AS es, sqrt(sse / (n - 2) * (1.0::DOUBLE / n + mx * mx / sxx)) AS ei FROM fit),
terms AS (
  SELECT 'price' AS term, slope AS estimate, es AS std_error, slope / es AS t, CAST(n - 2 AS DOUBLE) AS v FROM errors
  UNION ALL SELECT '(intercept)', intercept, ei, intercept / ei, CAST(n - 2 AS DOUBLE) FROM errors),
density AS (
  SELECT term, i, power(1 + power(abs(t) * i / 4000.0::DOUBLE, 2) / v, -(v + 1) / 2) AS f
  FROM terms, (SELECT unnest(generate_series(0, 4000)) AS i)),
area AS (
  SELECT term, sum(f * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / 3 AS s FROM density GROUP BY term)
SELECT t.term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(t, 6) AS t,
       round(greatest(1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * s * abs(t) / 4000, 0), 4) AS p
FROM terms t JOIN area a ON t.term = a.term
""",
)
def coefficient_table(spark, d):
    """One model in full; the check integrates the t density numerically."""
    table = models.coefficient_table(t.study(spark, d).where("category = 'SMALL'"), "wears", "price")
    return rounded(rounded(table, 6, "estimate", "std_error", "t"), 4, "p")


@query(
    "R2_repairs_by_user",
    """
SELECT "user", count(*) AS repaired_items, coalesce(sum(price), 0) AS repaired_value FROM study WHERE repaired > 0
GROUP BY "user"
""",
)
def repairs_by_user(spark, d):
    return repairs.repairs_by_user(t.study(spark, d))


@query(
    "R2_repairs_by_category",
    "SELECT category, count(*) AS repaired_items FROM study WHERE repaired > 0 GROUP BY category",
)
def repairs_by_category(spark, d):
    return repairs.repairs_by_category(t.study(spark, d))


@query(
    "R2_repair_counts",
    'SELECT "user", count(*) AS items, coalesce(sum(repaired), 0) AS repaired FROM study GROUP BY "user"',
)
def repair_counts(spark, d):
    return repairs.repair_counts(t.study(spark, d))


@query(
    "R3_repair_needs",
    """
SELECT "user", count(*) AS total_items, coalesce(sum(price), 0) AS total_value FROM study
WHERE needs_repair AND date_divested IS NULL GROUP BY "user"
""",
)
def repair_needs(spark, d):
    return repairs.repair_needs_by_user(t.study(spark, d))


@query(
    "R3_repair_delta",
    """
SELECT "user", category, item, needs_repair_start, needs_repair, repaired FROM study
WHERE date_divested IS NULL AND needs_repair IS NOT NULL AND (needs_repair_start OR needs_repair)
""",
)
def repair_delta(spark, d):
    return repairs.repair_delta(t.study(spark, d))


def cells(column: str, values, test: str = "", null: bool = False) -> str:
    count = f"count(*) FILTER (WHERE {column} = '{{v}}'{test})"
    cell = f"nullif({count}, 0)" if null else count
    listed = ", ".join(f"'{v}'" for v in values)
    rest = {"unknown": f"{column} IS NULL", "other": f"{column} NOT IN ({listed})"}
    extra = [f"count(*) FILTER (WHERE {where}{test})" for where in rest.values()]
    extra = [f'{f"nullif({x}, 0)" if null else x} AS "{name}"' for x, name in zip(extra, rest)]
    return ", ".join([cell.format(v=v) + f' AS "{v}"' for v in values] + extra)


@query(
    "R4_repair_kind_by_category",
    f"SELECT repair_kind, {cells('category', t.CATEGORIES)} FROM study WHERE needs_repair GROUP BY repair_kind",
)
def repair_kinds(spark, d):
    return repairs.repair_crosstab(t.study(spark, d), "repair_kind", "category", t.CATEGORIES)


@query(
    "R4_reason_by_user",
    f"""SELECT "user", {cells('reason_not_repaired', t.WAYS)} FROM study WHERE needs_repair GROUP BY "user\"""",
)
def reasons_by_user(spark, d):
    """One row per user: their number grows with the study, that of the reasons does not."""
    return repairs.repair_crosstab(t.study(spark, d), "user", "reason_not_repaired", t.WAYS)


@query(
    "R4_willingness_by_user",
    f"""SELECT "user", {cells('repair_willing_to_pay', ['F', 'O'])} FROM study WHERE needs_repair GROUP BY "user\"""",
)
def willingness_by_user(spark, d):
    return repairs.repair_crosstab(t.study(spark, d), "user", "repair_willing_to_pay", ["F", "O"])


@query(
    "R4_repair_reasons",
    f"""
SELECT reason_not_repaired, count(*) AS items, {strict('price')} AS "value" FROM study WHERE needs_repair
GROUP BY reason_not_repaired
""",
)
def repair_reasons(spark, d):
    return repairs.repair_reasons(t.study(spark, d))


def divestment_sql(by: str) -> str:
    return f"""
SELECT {by}, count(*) AS items_divested, {even('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 2)} AS share_of_total
FROM study WHERE date_divested > {START} GROUP BY {by}
"""


@query("R5_divestments_by_way", divestment_sql("divestment_way"))
def divestments_by_way(spark, d):
    table = repairs.divestments(t.study(spark, d), "divestment_way", t.STUDY_START)
    return table.orderBy(F.desc("items_divested"), "divestment_way")


@query("R5_divestments_by_condition", divestment_sql("condition"))
def divestments_by_condition(spark, d):
    table = repairs.divestments(t.study(spark, d), "condition", t.STUDY_START)
    return table.orderBy(F.desc("items_divested"), "condition")


def way_query(row):
    column = '"user"' if row == "user" else row

    @query(
        f"R6_{row}_by_way",
        f"SELECT {column}, {cells('divestment_way', t.WAYS, null=True)} FROM study WHERE date_divested > {START} GROUP BY {column}",
    )
    def ways(spark, d):
        return repairs.divestment_matrix(t.study(spark, d), row, t.WAYS, t.STUDY_START)

    return ways


for _row in ("condition", "user", "category"):
    way_query(_row)

LABELS = [f"{category} [{category}/{band}]" for category in t.CATEGORIES for band in range(1, 6)]
USED = """
used AS (SELECT "user", date, category || ' [' || item || ']' AS item FROM log WHERE used)
"""
PAIRS = f"""
WITH {USED},
pairs AS (
  SELECT a."user", a.item AS "from", b.item AS "to", count(*) AS weight
  FROM used a JOIN used b ON a."user" = b."user" AND a.date = b.date AND a.item < b.item
  GROUP BY a."user", a.item, b.item)
"""
SPLIT = """
SELECT "user", split_part("from", ' [', 1) AS cat_1, replace(split_part("from", ' [', 2), ']', '') AS item_1,
       split_part("to", ' [', 1) AS cat_2, replace(split_part("to", ' [', 2), ']', '') AS item_2, weight
FROM pairs
"""


def responses(spark, d):
    """Diary forms: one row per user and date, one text cell per item."""
    log = t.log(spark, d).select(
        "user",
        F.col("date").alias("Diary entry date"),
        item_label("category", "item").alias("_label"),
        F.when(F.col("used"), "Used today").otherwise("In the wardrobe").alias("_text"),
    )
    forms = log.groupBy("user", "Diary entry date").pivot("_label", LABELS).agg(F.first("_text"))
    return forms.withColumn("Timestamp", F.current_timestamp())


@query(
    "Q1_used_by_date",
    f"WITH {USED} SELECT * FROM used WHERE item NOT LIKE 'PROMO%' AND item NOT LIKE 'SMALL%'",
)
def used_by_date(spark, d):
    return cowear.used_by_date(responses(spark, d), keys=["user"], exclude_categories=["PROMO", "SMALL"])


def used(spark, d):
    return cowear.labelled_use(t.log(spark, d))


@query(
    "Q2_unknown_items",
    """
SELECT DISTINCT g."user", g.category || ' [' || g.item || ']' AS item
FROM log g JOIN items i ON g."user" = i."user" AND g.item = i.item WHERE g.used AND i.price IS NULL
""",
)
def unknown_items(spark, d):
    """Used items that a list of priced items does not have."""
    return cowear.unknown_items(used(spark, d), t.items(spark, d).where("price IS NOT NULL"))


def pairs(spark, d):
    return cowear.cowear_pairs(used(spark, d))


@query("Q3_cowear_pairs", PAIRS + "SELECT * FROM pairs")
def cowear_pairs(spark, d):
    return pairs(spark, d)


@query(
    "Q4_strongest_pairs",
    PAIRS + 'SELECT * FROM pairs ORDER BY weight DESC, "user", "from", "to" LIMIT 10',
)
def strongest_pairs(spark, d):
    return cowear.top_pairs(pairs(spark, d), 10)


@query(
    "Q4_weakest_pairs",
    PAIRS + 'SELECT * FROM pairs ORDER BY weight, "user", "from", "to" LIMIT 10',
)
def weakest_pairs(spark, d):
    return cowear.top_pairs(pairs(spark, d), 10, strongest=False)


@query(
    "Q4_pairs_of_category",
    PAIRS
    + f""", split AS ({SPLIT}), found AS (SELECT * FROM split WHERE cat_1 = 'SMALL' OR cat_2 = 'SMALL')
SELECT *, round(weight / CAST((SELECT max(weight) FROM found) AS DOUBLE), 9) AS scaled_weight FROM found""",
)
def pairs_of_category(spark, d):
    return rounded(cowear.pairs_of(cowear.split_pairs(pairs(spark, d)), "SMALL"), 9, "scaled_weight")


@query(
    "Q5_item_index",
    'SELECT "user", category, item, row_number() OVER (PARTITION BY "user", category ORDER BY item) AS item_index FROM items',
)
def item_index(spark, d):
    return cowear.item_index(t.items(spark, d))


@query(
    "Q5_indexed_pairs",
    PAIRS
    + f""", split AS ({SPLIT}), numbered AS (
  SELECT "user", category, item, row_number() OVER (PARTITION BY "user", category ORDER BY item) AS n FROM items)
SELECT s."user", cat_1, a.n AS index_1, cat_2, b.n AS index_2, weight
FROM split s JOIN numbered a ON s."user" = a."user" AND s.cat_1 = a.category AND s.item_1 = a.item
JOIN numbered b ON s."user" = b."user" AND s.cat_2 = b.category AND s.item_2 = b.item""",
)
def indexed_pairs(spark, d):
    return cowear.index_pairs(cowear.split_pairs(pairs(spark, d)), cowear.item_index(t.items(spark, d)))


@query(
    "Q6_category_counts",
    """
SELECT c.category, c.rank, greatest(count(i.item), 1) AS items
FROM (SELECT * FROM dim UNION ALL SELECT 'UNLISTED', 7) c LEFT JOIN items i ON c.category = i.category
GROUP BY c.category, c.rank
""",
)
def category_counts(spark, d):
    return cowear.category_counts(t.items(spark, d), t.dim(spark, [*t.CATEGORIES, "UNLISTED"]))
