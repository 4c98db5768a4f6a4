from __future__ import annotations

import datetime as dt

import math

import pytest
from pyspark.sql import functions as F

from helpers import make_study, one, rows
from wearlog.functions.numeric import as_int
from wearlog.operators import cleaning, cost_per_wear, models, ordered, repairs, secondhand, wear_rate
from wearlog.operators import distributions as dist
from wearlog.operators import study as ops
from wearlog.schema import category_dim

START = dt.date(2021, 9, 1)
BEFORE, AFTER = dt.date(2020, 5, 1), dt.date(2022, 3, 1)


@pytest.fixture(scope="module")
def small(spark):
    """Two users, three categories, wears on all tier borders."""
    data = [
        {"wears": 0.0, "price": 100.0, "date_purchased": BEFORE},
        {"wears": 1.0, "price": 50.0, "date_purchased": BEFORE, "secondhand": True},
        {"wears": 3.0, "price": None, "date_purchased": None},
        {"wears": 4.0, "price": 30.0, "date_purchased": AFTER, "secondhand": False},
        {"wears": 5.0, "price": 20.0, "date_purchased": BEFORE, "date_divested": AFTER},
        {"wears": 50.0, "price": 10.0, "category": "Knits", "date_purchased": BEFORE},
        {"wears": 51.0, "price": 0.0, "category": "Knits", "date_purchased": START},
        {"user": "u2", "wears": 2.0, "price": 80.0, "category": "Pants", "date_purchased": AFTER},
    ]
    return make_study(spark, data)


def test_wardrobe_by_user(small):
    assert rows(ops.wardrobe_by_user(small)) == [("u1", 6, pytest.approx(5 / 6), 190.0), ("u2", 1, 1.0, 80.0)]


def test_average_counts_excluded_users_too(small):
    found = ops.wardrobe_by_category(small, exclude=["u2"])
    assert rows(found, "category", "items", "average_items") == [("Knits", 2, 1.0), ("Shirts", 4, 2.0)]
    given = ops.wardrobe_by_category(small, exclude=["u2"], n_users=4)
    assert rows(given, "category", "average_items") == [("Knits", 0.5), ("Shirts", 1.0)]


def test_changes_balance(small):
    found = ops.change_by_user_category(small, START)
    assert found.where("items_at_start + new_items - divested_items <> items_at_end").count() == 0
    assert found.where("value_at_start + value_new_items - value_divested_items <> value_at_end").count() == 0
    u1 = ops.change_by_user(small, START).where("user = 'u1'")
    assert one(u1, "items_at_start", "new_items", "divested_items", "items_at_end", "change_percent", "share_new") == (
        6, 1, 1, 6, 0.0, 0.17,
    )


def test_metrics_against_the_mean_user(small):
    found = ops.key_metrics(small)
    assert rows(found, "user", "items", "items_delta", "avg_item_value", "avg_item_value_delta") == [
        ("u1", 6, 0.71, 31.67, -0.43), ("u2", 1, -0.71, 80.0, 0.43),
    ]


def test_start_matrix_and_order_of_columns(small):
    found = ops.start_matrix(small, START, ["Pants", "Shirts", "Knits"])
    assert found.columns == ["user", "Pants", "Shirts", "Knits"]
    assert rows(found) == [("u1", None, 4, 2)]


def test_clean_study_filters(spark):
    data = [
        {"item": "sunglasses", "category": "Accessories"},
        {"item": "glasses cloth", "category": "Shirts"},
        {"item": "no category", "category": None},
        {"item": "other", "category": "Other"},
        {"item": "gone before", "date_divested": dt.date(2021, 8, 31)},
        {"item": "gone at start", "date_divested": START},
    ]
    assert rows(cleaning.clean_study(make_study(spark, data), START), "item") == [("glasses cloth",), ("gone at start",)]


def test_category_changes(spark):
    items = make_study(spark, [{"item": "a"}, {"item": "b"}, {"item": "c"}, {"item": "a", "user": "u2"}])
    changes = spark.createDataFrame(
        [(1, "u1", "a", "Pants"), (2, "u1", "a", "Knits"), (3, "u1", "b", "Nowhere")],
        "change_seq long, user string, item string, target_category string",
    )
    found = cleaning.apply_category_changes(items, changes, category_dim(spark, ["Knits", "Pants", "Shirts"]))
    assert rows(found, "user", "item", "category") == [
        ("u1", "a", "Knits"), ("u1", "b", None), ("u1", "c", "Shirts"), ("u2", "a", "Shirts"),
    ]


def test_currency_and_profiles_drop_unknown_users(spark, small):
    users = spark.createDataFrame([("u1", "Female", 0.5)], "user string, gender string, exchange_rate double")
    found = cleaning.normalise_currency(small.withColumn("cpw", F.lit(0.25)), users)
    assert {r[0] for r in rows(found, "user")} == {"u1"}
    assert rows(found.where("price = 50"), "cpw") == [(0.12,)]
    assert cleaning.with_profile(small, users).count() == 7


def test_user_subsets_by_list_and_table(spark, small):
    table = spark.createDataFrame([("u2",)], "user string")
    for chosen in (["u2"], table):
        assert cleaning.for_users(small, include=chosen).count() == 1
        assert cleaning.for_users(small, exclude=chosen).count() == 7


def test_links_and_search_and_union(spark):
    links = spark.createDataFrame(
        [("a", "/app/a", "http://x?dl=0"), ("a", "/app/a", "http://x?dl=0"), ("b", "/else/b", "http://y?dl=0")],
        "name string, path string, photo_url string",
    )
    table = cleaning.link_table(links, "/app/")
    assert rows(table) == [("a", "/app/a", "http://x?raw=1")]
    files = spark.createDataFrame([("a", "p"), ("c", "q")], "item string, path string")
    assert rows(cleaning.missing_links(files, table), "item") == [("c",)]
    assert rows(cleaning.find_items(spark.createDataFrame([("Blue BRAND top",), ("x",)], "item string"), "brand")) == [("Blue BRAND top",)]
    assert rows(cleaning.union_fill(files, spark.createDataFrame([("z", 1)], "item string, n int")).where("item = 'z'")) == [("z", None, 1)]


def test_first_extract_wins(spark):
    parts = [
        spark.createDataFrame([("2020-01-01", "10"), ("2020-01-02", "x")], "dateTime string, value string"),
        spark.createDataFrame([("2020-01-01", "99"), ("2020-01-03", "30")], "dateTime string, value string"),
    ]
    assert [(r[0].day, r[1]) for r in rows(cleaning.merge_steps(parts))] == [(1, 10.0), (2, None), (3, 30.0)]


def test_secondhand_shares(spark):
    data = [
        {"secondhand": True, "price": 10.0, "date_purchased": BEFORE},
        {"secondhand": False, "price": 30.0, "date_purchased": BEFORE},
        {"secondhand": True, "price": 5.0, "date_purchased": AFTER},
        {"secondhand": True, "price": None, "date_purchased": None},
        {"user": "u2", "secondhand": None, "price": 1.0, "date_purchased": BEFORE},
    ]
    items = make_study(spark, data)
    by_number = rows(secondhand.secondhand_share(items, START))
    assert by_number == [("u1", 2, 1, 1, 1, 0.5, 1.0, 0.5), ("u2", 1, None, None, None, None, None, None)]
    by_value = rows(secondhand.secondhand_value_share(items, START))
    assert by_value == [("u1", 40.0, 10.0, 5.0, 5.0, 0.25, 1.0, 0.75)]
    assert one(secondhand.users_with_secondhand(items)) == (1, 3)
    assert rows(secondhand.secondhand_by_user(items), "user", "secondhand", "share") == [("u1", 3, 0.75), ("u2", None, None)]


def test_secondhand_gaps(spark):
    data = [
        {"secondhand": False, "price": 40.0, "wears": 0.0},
        {"secondhand": True, "price": 10.0, "wears": 5.0},
        {"category": "Knits", "secondhand": True, "price": 9.0, "wears": 1.0},
        {"category": "Other", "secondhand": True, "price": 9.0, "wears": 1.0},
    ]
    items = make_study(spark, data)
    gaps = secondhand.secondhand_price_gap(items)
    assert rows(gaps) == [("u1", "Shirts", 40.0, 10.0, 0.25)]
    assert rows(secondhand.mean_gap(gaps)) == [("Shirts", 1, 0.25)]
    assert rows(secondhand.secondhand_wear_gap(items)) == []  # used over zero new wears is no ratio


def test_tiers_cover_all_items_and_end_at_one(small):
    found = dist.wear_tiers(small)
    assert found.agg(F.sum("items")).first()[0] == 8
    last = found.groupBy("category").agg(F.max_by("cum_share", "tier_rank")).collect()
    assert {r[1] for r in last} == {1.0}
    assert rows(found.where("category = 'Knits'"), "tier", "items", "cum_items", "cum_share") == [
        ("21-50", 1, 1, 0.5), ("Over 50", 1, 2, 1.0),
    ]
    matrix = dist.wear_tier_matrix(small, ["Shirts", "Knits"])
    assert rows(matrix.where("tier = '4-5'"), "Shirts", "Knits") == [(2, None)]


def test_histogram_bins_are_closed_on_the_right(spark):
    items = make_study(spark, [{"price": p} for p in (0.0, 10.0, 10.5, 20.0, 25.0, -1.0, 40.0, None)])
    assert rows(dist.histogram(items, "price", 10, 30), "bin", "items", "bin_from", "bin_to") == [
        (0, 2, 0.0, 10.0), (1, 2, 10.0, 20.0), (2, 1, 20.0, 30.0),
    ]
    centred = dist.histogram(items, "price", 10, 30, centred=True)
    assert rows(centred, "bin", "items", "bin_from") == [(0, 1, -5.0), (1, 2, 5.0), (2, 2, 15.0)]


def test_ranks_follow_value_then_name(spark):
    data = [{"item": i, "price": p} for i, p in (("d", None), ("b", 200.0), ("c", 10.0), ("a", 10.0))]
    found = dist.ranked_items(make_study(spark, data), "price")
    assert rows(found, "index", "item", "price") == [(1, "b", 150.0), (2, "a", 10.0), (3, "c", 10.0), (4, "d", None)]


def test_shares_of_wears(small):
    assert rows(dist.share_worn(small, 4, below=True).where("category = 'Shirts'"), "items", "share_worn") == [(4, 0.75)]
    by_user = dist.rarely_worn(small, exclude=["Pants"])
    assert rows(by_user) == [("u1", 7, 6, 4, 0.14, 0.43)]
    assert one(dist.rarely_worn_overall(by_user)) == (pytest.approx(1 / 7), pytest.approx(3 / 7))
    assert rows(dist.share_above(small, 50, 2), "category", "share_above", "few_wears") == [
        ("Knits", 0.5, 0), ("Pants", 0.0, 1), ("Shirts", 0.0, 2),
    ]


def test_cost_per_wear(small):
    diary = cost_per_wear.cpw_diary(small)
    assert rows(diary.where("category = 'Shirts'"), "plot_wears", "cpw") == [(0.0, 100.0), (1.0, 50.0), (4.0, 7.5), (5.0, 4.0)]
    segments = cost_per_wear.wear_segments(diary).where("category = 'Shirts'")
    assert one(segments, "items", "value", "share_items_0_4", "share_value_5_50", "share_items_51_up") == (4, 200.0, 0.75, 0.1, 0.0)
    assert one(cost_per_wear.cpw_summary(diary).where("category = 'Shirts'"), "cpw_mean", "cpw_median") == (40.38, 28.75)


def test_wears_per_wash(spark):
    data = [{"wears": w, "washed": n} for w, n in ((3.0, 0.0), (0.0, 0.0), (7.0, 2.0), (5.0, None))]
    items = make_study(spark, data)
    found = cost_per_wear.wears_per_wash(items).orderBy("item")
    assert [r.wears_per_wash for r in found.collect()] == [3.0, None, 3.5, None]
    assert one(cost_per_wear.wears_per_wash_matrix(items, ["Shirts"]), "Shirts") == (3.2,)


def test_divested_age_is_in_years(spark):
    items = make_study(spark, [{"date_purchased": dt.date(2020, 3, 1), "date_divested": AFTER}, {"date_divested": BEFORE}])
    items = items.withColumns({"cpw": F.lit(1.0), "divestment_way": F.lit("sold"), "condition": F.lit("good")})
    found = cost_per_wear.divested_age(items, START)
    assert one(found, "wardrobe_age") == (2.0,)
    assert rows(cost_per_wear.mean_divested_age(found)) == [("Shirts", 1, 2.0)]


def test_wears_per_month(spark):
    bought = dt.date(2021, 5, 31)
    data = [
        {"item": "none", "date_purchased": START, "total_wears": 5.0, "wears": 5.0},
        {"item": "some", "date_purchased": bought, "total_wears": 10.0, "wears": 12.0},
        {"item": "zero", "date_purchased": bought, "total_wears": 2.0, "wears": 0.0},
        {"item": "both", "date_purchased": bought, "total_wears": 0.0, "wears": 0.0},
        {"item": "unknown", "date_purchased": bought, "total_wears": None, "wears": 3.0},
    ]
    found = wear_rate.wpm_items(make_study(spark, data), START)
    assert rows(found, "item", "months_available", "wpm_est", "wpm_real", "wpm_delta") == [
        ("both", 4, 0.0, 0.0, None), ("some", 4, 2.5, 1.0, 2.5), ("zero", 4, 0.5, 0.0, 5.0),
    ]
    assert one(wear_rate.wpm_category(found), "est", "real", "delta_to_real", "delta_to_max") == (3.0, 1.0, 3.0, 0.1)
    idle = found.where("item = 'zero'")
    assert one(wear_rate.wpm_category(idle), "delta_to_real") == (5.0,)
    assert one(wear_rate.wpm_category(idle, on_zero="null", digits=2), "delta_to_real", "delta_to_max") == (None, 0.02)


@pytest.mark.parametrize(
    "wears, biased, unbiased", [([0, 0, 4], 2 / 3, 1.0), ([1, 1], 0.0, 0.0), ([5], 0.0, None), ([0, 0], None, None)]
)
def test_gini(spark, wears, biased, unbiased):
    items = make_study(spark, [{"wears": float(w)} for w in wears])
    for expected, flag in ((biased, False), (unbiased, True)):
        found = ordered.gini(items, ["user"], "wears", flag).collect()[0].gini
        assert found == (None if expected is None else pytest.approx(expected))


def test_category_wears(spark):
    items = make_study(spark, [{"wears": w, "total_wears": 1.0} for w in (0.0, 0.0, 4.0)])
    found = wear_rate.category_wears(items)
    assert one(found, "total_wears", "category_potential", "gini", "avg_wears", "supply_in_years") == (4.0, 8.0, 1.0, 1.0, 2.0)


def test_changed_estimates(spark):
    now = make_study(spark, [{"item": "a", "total_wears": 3.0}, {"item": "b", "total_wears": 2.0}])
    then = make_study(spark, [{"item": "a", "total_wears": 1.0}, {"item": "b", "total_wears": 2.0}, {"item": "c", "total_wears": 9.0}])
    assert rows(wear_rate.estimate_changes(now, then), "item", "wears_change") == [("a", 2.0)]


def test_linear_fit(spark):
    points = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (4.0, 7.0), (None, 1.0)], "x double, y double")
    fit = models.linear_fit(points, "y", "x").collect()[0]
    assert (fit.n, fit.slope, fit.intercept) == (3, pytest.approx(12 / 7), pytest.approx(0, abs=1e-12))
    assert fit.r2 == pytest.approx(0.979592, abs=1e-6)
    terms = {r.term: r for r in models.coefficient_table(points, "y", "x").collect()}
    assert terms["x"].estimate == pytest.approx(fit.slope) and terms["x"].std_error == pytest.approx(fit.slope_se)
    assert terms["(intercept)"].std_error == pytest.approx(fit.intercept_se)
    # With one degree of freedom the t distribution is the Cauchy distribution.
    assert terms["x"].t == pytest.approx(fit.slope_t)
    assert terms["x"].p == pytest.approx(1 - 2 / math.pi * math.atan(abs(fit.slope_t)), abs=1e-9)


def test_repairs_and_divestments(spark):
    data = [{"price": 10.0}, {"price": None}, {"date_divested": AFTER}, {"date_divested": AFTER, "user": "u2"}, {"date_divested": BEFORE}]
    i = F.col("item")
    items = make_study(spark, data).withColumns(
        {
            "repaired": F.when(i == "item 000", 2.0),
            "needs_repair": i.isin("item 000", "item 001"),
            "reason_not_repaired": F.lit("time"),
            "divestment_way": F.when(F.col("user") == "u2", "sold").otherwise("given"),
        }
    )
    assert rows(repairs.repairs_by_user(items)) == [("u1", 1, 10.0)]
    assert rows(repairs.repair_needs_by_user(items)) == [("u1", 2, 10.0)]
    assert rows(repairs.repair_reasons(items)) == [("time", 2, None)]
    assert rows(repairs.repair_crosstab(items, "reason_not_repaired", "user", ["u1", "u2"])) == [("time", 2, 0, 0, 0)]
    assert rows(repairs.divestments(items, "divestment_way", START)) == [("given", 1, 0.5), ("sold", 1, 0.5)]
    assert rows(repairs.divestments(items, "divestment_way"), "divestment_way", "items_divested") == [("given", 2), ("sold", 1)]
    assert rows(repairs.divestment_matrix(items, "user", ["given", "sold"], START)) == [("u1", 1, None, None, None), ("u2", None, 1, None, None)]


def test_crosstab_loses_no_row(spark):
    items = make_study(spark, [{"category": c} for c in ("Shirts", "Pants", None, "Hats", "Hats")])
    found = ops.crosstab(items, "user", "category", ["Shirts", "Pants"], fill=0, unknown="unknown", other="other")
    assert rows(found) == [("u1", 1, 1, 1, 2)]
    with pytest.raises(Exception, match="Hats|null"):
        ops.crosstab(items, "user", "category", ["Shirts", "Pants"]).collect()
    with pytest.raises(ValueError):
        ops.crosstab(items, "user", "category", ["other"], other="other")


def test_largest_wardrobes(spark):
    items = make_study(spark, [{"price": 1.0}, {"price": 2.0}, {"user": "u2", "price": 9.0}])
    assert rows(ops.largest_wardrobes(items)) == [("items", "u1", 2, 3.0), ("value", "u2", 1, 9.0)]


def test_sentimental_share(spark):
    items = make_study(spark, [{}, {}, {}]).withColumn("sentimental_value", F.when(F.col("item") != "item 002", F.col("item") == "item 000"))
    assert rows(ops.sentimental_share(items)) == [("u1", 3, 1, 0.33)]
    assert one(items.agg(F.sum(as_int("sentimental_value")))) == (1,)


def test_plain_lists(small):
    assert rows(ops.valuable_items(small, 50), "price") == [(50.0,), (80.0,), (100.0,)]
    assert rows(ops.valuable_items(small, 50, ["Shirts"], above=True), "price") == [(100.0,)]
    assert one(ops.totals(small)) == (8, 290.0, 1, 2, 1)
    assert rows(dist.top(small, "wears", 2, ties=["item"]), "wears") == [(50.0,), (51.0,)]
    assert rows(dist.top(small, "price", 1, largest=False), "price") == [(0.0,)]
    assert rows(dist.top_groups(small, ["user", "category"], 1)) == [("u1", "Shirts", 5)]
    assert rows(ops.short_lived(small, START)) == []
