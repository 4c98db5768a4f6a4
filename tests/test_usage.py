from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import day, make_items, make_log, one, rows
from wearlog.operators import cleaning, daily_cost, listings, portfolio, usage
from wearlog.schema import category_dim

START, END = day(1), day(5)


@pytest.fixture(scope="module")
def basic(spark):
    """Two items over five days: an empty cell, a purchase and a divestment within the range."""
    log = make_log(
        spark,
        [("a", day(d), d in (1, 2, 4)) for d in (1, 2, 4, 5)] + [("b", day(d), d == 3) for d in range(1, 6)],
    )
    items = make_items(spark, [("a", 60.0, day(22, 12, 2019), None, 1.0), ("b", 30.0, day(2), day(3), 0.0)])
    return log, items


def test_log_is_clipped_to_ownership(basic):
    log, items = basic
    clipped = cleaning.clip_to_ownership(log, items, START, END)
    assert rows(clipped, "item", "date") == sorted(
        [("a", day(d)) for d in (1, 2, 4, 5)] + [("b", day(2)), ("b", day(3))], key=str
    )
    facts = usage.with_item_facts(log, items)
    assert rows(usage.within_ownership(facts, START, END), "item", "date") == rows(clipped, "item", "date")


def test_copies_of_an_item_clip_by_latest_purchase_and_earliest_divestment(spark, basic):
    log, _ = basic
    items = make_items(spark, [("b", 1.0, day(1), day(4), 0.0), ("b", 2.0, day(2), None, 0.0)])
    kept = cleaning.clip_to_ownership(log.where("item = 'b'"), items, START, END)
    assert [r[0] for r in rows(kept, "date")] == [day(2), day(3), day(4)]


def test_usage_table(basic):
    log, items = basic
    use = usage.usage_table(log, items, START, END)
    a = use.where("item = 'a'").orderBy("date").select("cumuse", "cost_per_use", "days_active", "active")
    assert [tuple(r) for r in a.collect()] == [
        (2.0, 30.0, 10, True),
        (3.0, 20.0, 11, True),
        (4.0, 15.0, 12, True),
        (4.0, 15.0, 13, True),
    ]
    b = use.where("item = 'b'").orderBy("date").select("date", "used", "active", "cumuse", "cost_per_use", "days_active", "plot_size")
    assert [tuple(r) for r in b.collect()] == [
        (day(2), False, True, 0.0, 30.0, 1, 0.05),
        (day(3), True, True, 1.0, 30.0, 2, 0.05),
        (day(4), False, False, 1.0, 30.0, 2, 0.07),
        (day(5), False, False, 1.0, 30.0, 2, 0.07),
    ]


def test_days_active_from_the_start_day(spark):
    """Bought before, on and after the start; without a date all later sums are unknown."""
    purchases = {"before": day(31, 12, 2019), "on": START, "later": day(2), "never": None}
    log = make_log(spark, [(i, day(d), False) for i in purchases for d in (1, 2) if not (i == "later" and d == 1)])
    items = make_items(spark, [(i, 1.0, p, None, 0.0) for i, p in purchases.items()])
    found = usage.active_use(log, items, START)
    expected = [("before", day(1), 1), ("before", day(2), 2), ("later", day(2), 1), ("on", day(1), 0), ("on", day(2), 1)]
    assert rows(found.where("item <> 'never'"), "item", "date", "days_active") == expected
    assert rows(found.where("item = 'never'"), "days_active") == [(None,), (None,)]


def test_item_without_purchase_date_after_the_start_day_is_known(spark):
    log = make_log(spark, [("x", day(3), True)])
    found = usage.active_use(log, make_items(spark, [("x", 1.0, None, None, 0.0)]), START)
    assert one(found, "days_active", "use_per_month") == (1, 30.5)


def test_unknown_initial_uses_and_prices(spark):
    log = make_log(spark, [("a", day(1), True), ("b", day(1), False), ("c", day(1), False)])
    items = make_items(spark, [("a", None, START, None, 3.0), ("b", 9.0, START, None, None), ("c", 9.0, START, None, 0.0)])
    found = usage.cumulative_use(log, items)
    assert rows(found, "item", "cumuse", "cost_per_use") == [("a", 4.0, None), ("b", None, None), ("c", 0.0, 9.0)]


def test_copies_of_an_item_multiply_the_log(spark):
    log = make_log(spark, [("a", day(1), True)])
    items = make_items(spark, [("a", 10.0, START, None, 0.0), ("a", 20.0, START, None, 0.0)])
    found = usage.cumulative_use(log, items)
    assert rows(found, "price", "cumuse", "cost_per_use") == [(10.0, 1.0, 10.0), (20.0, 1.0, 20.0)]


def test_each_copy_of_an_item_is_carried(spark):
    log = make_log(spark, [("a", day(1), True), ("a", day(2), True), ("b", day(4), True)])
    items = make_items(spark, [("a", 10.0, START, day(3), 0.0), ("a", 30.0, START, day(3), 1.0), ("b", 1.0, START, None, 0.0)])
    found = usage.usage_table(log, items, START, day(4)).where("item = 'a'")
    cheap = [(day(1), 10.0, 1.0, True), (day(2), 10.0, 2.0, True), (day(3), 10.0, 2.0, False), (day(4), 10.0, 2.0, False)]
    dear = [(day(1), 30.0, 2.0, True), (day(2), 30.0, 3.0, True), (day(3), 30.0, 3.0, False), (day(4), 30.0, 3.0, False)]
    assert rows(found.where("price = 10"), "date", "price", "cumuse", "active") == cheap
    assert rows(found.where("price = 30"), "date", "price", "cumuse", "active") == dear


def test_last_state_is_the_last_day_of_the_usage_table(spark):
    rng = random.Random(12)
    facts = [
        (f"i{i}", rng.choice([None, 10.0, 30.0]), rng.choice([None, day(rng.randint(1, 5)), dt.date(2019, 12, 1)]), rng.choice([None, day(8)]), rng.choice([None, 0.0, 2.0]))
        for i in range(40)
    ]
    facts.append((facts[0][0], 77.0, day(1), None, 5.0))
    log = make_log(spark, [(f"i{i}", day(d), rng.choice([True, False, None])) for i in range(40) for d in range(1, rng.randint(3, 12))])
    items = make_items(spark, facts).withColumn("photo", F.concat("item", F.lit(".png")))
    whole, last = usage.usage_table(log, items, START, day(10)), usage.last_state(log, items, START, day(10))
    assert last.schema.simpleString() == whole.schema.simpleString()
    assert rows(last) == rows(usage.latest(whole, last=day(10)))


def test_last_log_row_decides_on_carry_forward(spark):
    """An item with empty cells at the end looks divested without a date."""
    log = make_log(spark, [("a", day(1), True), ("a", day(2), True)])
    items = make_items(spark, [("a", 10.0, START, None, 0.0)])
    use = usage.usage_table(log, items, START, END)
    assert rows(use, "date", "active", "used") == [
        (day(1), True, True), (day(2), True, True), (day(3), False, False), (day(4), False, False), (day(5), False, False),
    ]
    assert rows(usage.log_gaps(use, items)) == [("me", "a")]


def test_carry_forward_fills_every_day_once(spark):
    log = make_log(spark, [(i, day(d), True) for i in "abc" for d in range(1, {"a": 3, "b": 6, "c": 2}[i])])
    items = make_items(spark, [(i, 1.0, START, None, 0.0) for i in "abc"])
    counts = usage.usage_table(log, items, START, END).groupBy("item").agg(F.count("*"), F.count_distinct("date"))
    assert rows(counts) == [(i, 5, 5) for i in "abc"]


def test_category_rank_orders_the_window_and_drops_unknown(spark):
    dim = category_dim(spark, ["Knits", "Shirts"])
    ranked = cleaning.with_category_rank(make_log(spark, [("a", day(1), True), ("b", day(1), True, "Hats")]), dim)
    assert rows(ranked, "item", "category", "rank") == [("a", "Shirts", 2), ("b", None, None)]


def test_placeholders_and_latest_and_thinning(spark):
    log = make_log(spark, [("a", day(d), True) for d in range(1, 6)] + [("ADD NEXT", day(5), False)])
    kept = cleaning.drop_placeholders(log)
    assert rows(usage.latest(kept), "item", "date") == [("a", day(5))]
    assert [r[0] for r in rows(usage.thin_dates(kept), "date")] == [day(1), day(3), day(5)]


@pytest.fixture(scope="module")
def long_log(spark):
    """35 days of one category in which every second day is used."""
    first = dt.date(2020, 1, 1)
    days = [first + dt.timedelta(days=i) for i in range(35)]
    log = make_log(spark, [("a", d, i % 2 == 0) for i, d in enumerate(days)])
    items = make_items(spark, [("a", 36.0, first, None, 0.0)])
    return usage.usage_table(log, items, first, days[-1]), days


def test_rolling_category_use_needs_thirty_rows(long_log):
    use, days = long_log
    found = [tuple(r) for r in portfolio.inventory(use).orderBy("date").select("rolling_category_use", "category_turnaround", "itemcount").collect()]
    assert [r[0] for r in found[:29]] == [None] * 29
    assert found[29] == (0.5, 15.0, 1)
    assert len(found) == 35


def test_counting_distinct_items_is_the_default(long_log):
    use, _ = long_log
    copies = use.unionByName(use)
    assert {r.itemcount for r in portfolio.inventory(copies).collect()} == {1}
    assert {r.itemcount for r in portfolio.inventory(copies, one_row_per_day=True).collect()} == {2}


def test_use_to_date(long_log):
    use, days = long_log
    last = usage.latest(portfolio.use_to_date(use)).collect()[0]
    assert (last.cumuse, last.category_value, last.daily_cost) == (18.0, 36.0, 2.0)
    assert last.category_use == pytest.approx(18 / 35)
    assert last.yearly_cost == pytest.approx(2 * 365 * 18 / 35)


def test_cost_to_date_without_use_is_unknown(spark):
    log = make_log(spark, [("a", day(1), False)])
    use = usage.usage_table(log, make_items(spark, [("a", 5.0, START, None, 0.0)]), START, day(1))
    assert one(portfolio.use_to_date(use), "cumuse", "daily_cost", "yearly_cost") == (0.0, None, None)


def test_daily_cost_mean_is_shifted_by_rows_with_use(long_log):
    """Windows count used days, not calendar days."""
    use, _ = long_log
    found = daily_cost.daily_cost(use, window=6).orderBy("date").collect()
    assert len(found) == 18 and {r.daily_cost for r in found} == {2.0} and all(r.still_active for r in found)
    known = [i for i, r in enumerate(found) if r.average_daily_cost is not None]
    assert known == list(range(2, 15))


def test_daily_cost_takes_the_lowest_cost_and_leaves_categories_out(spark):
    log = make_log(spark, [("a", day(1), True), ("a", day(2), True), ("s", day(2), True, "Sportswear"), ("n", day(2), True, None)])
    items = make_items(spark, [("a", 10.0, START, None, 0.0), ("s", 5.0, START, None, 0.0), ("n", 5.0, START, None, 0.0)])
    use = usage.usage_table(log, items, START, day(3))
    assert rows(daily_cost.daily_cost(use), "date", "daily_cost", "still_active") == [(day(1), 5.0, False), (day(2), 5.0, False)]
    wide = daily_cost.daily_cost(use, exclude=(), by_category=True)
    assert rows(wide, "category", "date", "daily_cost") == [("Shirts", day(1), 5.0), ("Shirts", day(2), 5.0), ("Sportswear", day(2), 5.0)]


def test_asof_cost_uses_only_earlier_rows(spark):
    log = make_log(spark, [("a", day(d), d in (1, 3)) for d in range(1, 5)])
    use = usage.usage_table(log, make_items(spark, [("a", 12.0, START, None, 0.0)]), START, day(4))
    found = daily_cost.daily_cost_asof(use, spark.createDataFrame([(day(2),), (day(4),)], "day date"), window=2)
    assert rows(found, "day", "date", "daily_cost", "still_active") == [
        (day(2), day(1), 12.0, True), (day(4), day(1), 6.0, True), (day(4), day(3), 6.0, True),
    ]
    whole = daily_cost.daily_cost(use, window=2)
    assert rows(found.where(F.col("day") == day(4)), "date", "daily_cost") == rows(whole, "date", "daily_cost")


def test_asof_cost_on_every_day_matches_brute_force(spark):
    rng = random.Random(11)
    facts = [(f"i{i}", rng.choice([None, 10.0, 30.0, 7.0]), day(rng.randint(1, 4)), rng.choice([None, day(9)]), float(i % 2)) for i in range(8)]
    log = make_log(spark, [(i, day(d), rng.random() < 0.5) for i, *_ in facts for d in range(1, 13)])
    use = usage.usage_table(log, make_items(spark, facts), START, day(14))
    days = spark.createDataFrame([(day(d),) for d in range(1, 15)], "day date")
    data, expected = use.select("item", "date", "cost_per_use", "active", "used").collect(), []
    for report in (day(d) for d in range(1, 15)):
        known = [r for r in data if r.date <= report]
        for date in sorted({r.date for r in known if r.used}):
            worn = [r.item for r in known if r.date == date and r.used]
            costs = [[r.cost_per_use for r in known if r.item == i] for i in worn]
            total = None if any(c is None for cs in costs for c in cs) else sum(min(cs) for cs in costs)
            active = any(all(r.active for r in known if r.item == i) for i in worn)
            expected.append((report, date, None if total is None else round(total, 9), active))
    found = daily_cost.daily_cost_asof(use, days, window=3)
    assert rows(found.select("day", "date", F.round("daily_cost", 9), "still_active")) == sorted(expected, key=lambda r: r[:2])


def test_trimmed_days(spark):
    days = spark.createDataFrame([(day(d),) for d in range(1, 31)], "day date")
    kept = daily_cost.trim_days(days, day(1), day(30), window=10)
    assert [r[0].day for r in rows(kept)] == list(range(10, 21))
    assert [r[0].day for r in rows(daily_cost.trim_days(days, day(1), day(30), window=10, step=2))] == list(range(10, 21, 2))


def test_divested_averages_need_thirty_days(spark):
    facts = [("old", False, 40, 4.0, 10.0), ("young", False, 10, 9.0, 1.0), ("kept", True, 50, 5.0, 1.0)]
    use = spark.createDataFrame(
        [("me", "Shirts", i, day(1), a, d, u, c) for i, a, d, u, c in facts],
        "user string, category string, item string, date date, active boolean, days_active int, cumuse double, cost_per_use double",
    )
    found = portfolio.divested_averages(use)
    assert rows(found, "item", "avg_use_per_month_divested", "avg_cost_per_use_divested") == [
        ("kept", None, None), ("old", 4 / 40 * 30.5, 10.0), ("young", None, None),
    ]


def test_listing_totals(spark):
    log = make_log(spark, [("a", day(1), True), ("a", day(2), True), ("k", day(1), True, "Knits"), ("p", day(2), True, "Pants")])
    items = make_items(
        spark, [("a", 10.0, START, None, 0.0), ("k", 30.0, START, None, 0.0, "Knits"), ("p", 7.0, START, None, 0.0, "Pants")]
    )
    use = usage.usage_table(log, items, START, day(2))
    dim = category_dim(spark, ["Knits", "Pants", "Shirts"])
    found = listings.category_listing(portfolio.category_reports(use), dim).orderBy("rank").collect()
    assert [(r.category, r.itemcount, r.categoryvalue) for r in found] == [("Total", 2, 17.0), ("Pants", 1, 7.0), ("Shirts", 1, 10.0)]
    total, pants, shirts = found
    assert total.yearly_cost == pytest.approx(pants.yearly_cost + shirts.yearly_cost)
    assert total.turnover == pytest.approx(total.yearly_cost / 17) and total.daily_cost is None
    assert rows(listings.item_listing(use), "item", "status", "times_worn", "cost_per_wear") == [
        ("a", "Active", 2.0, 5.0), ("k", "Divested", 1.0, 30.0), ("p", "Active", 1.0, 7.0),
    ]


def test_times_used_ranking_and_bands(spark):
    uses = [1.0, 2.0, 3.0, 4.0, 10.0]
    divested = [("me", "Shirts", f"d{i}", day(1), u, 10 + i, False) for i, u in enumerate(uses)]
    kept = [("me", "Shirts", "k1", day(1), 9.0, 5, True), ("me", "Knits", "k2", day(1), 9.0, 5, True)]
    use = spark.createDataFrame(
        divested + kept,
        "user string, category string, item string, date date, cumuse double, days_active int, active boolean",
    )
    found = listings.times_used(use)
    shirts = found.where("category = 'Shirts'").orderBy("rownumber").collect()
    assert [r["item"] for r in shirts] == ["d4", "d3", "d2", "d1", "d0", "k1"]
    assert [r.rownumber for r in shirts] == [1, 2, 3, 4, 5, 6]
    assert shirts[0].std1_low == pytest.approx(2.28) and shirts[0].std2_high == pytest.approx(8.8)
    assert one(found.where("category = 'Knits'"), "rownumber", "std1_low") == (1, None)


def test_steps_are_shared_by_shoes(spark):
    from wearlog.operators import steps

    columns = "user string, item string, date date, used boolean, cumuse double, days_active int, active boolean"
    use = spark.createDataFrame(
        [
            ("me", "a", day(1), True, 3.0, 1, True),
            ("me", "b", day(1), True, 0.0, 1, True),
            ("me", "a", day(2), False, 3.0, 2, True),
            ("me", "b", day(2), False, 0.0, 2, True),
            ("me", "a", day(3), True, 4.0, 3, True),
            ("me", "b", day(3), False, 0.0, 3, True),
            ("me", "a", day(4), True, 5.0, 4, True),
        ],
        columns,
    )
    daily = spark.createDataFrame([("me", day(1), 100.0), ("me", day(2), 70.0), ("me", day(3), 90.0)], "user string, date date, steps double")
    allocated = steps.allocate_steps(use, daily)
    assert rows(allocated, "item", "date", "steps") == [
        ("a", day(1), 50.0), ("a", day(2), 0.0), ("a", day(3), 90.0), ("b", day(1), 50.0), ("b", day(2), 0.0), ("b", day(3), 0.0),
    ]
    cumulative = steps.cumulative_steps(allocated, day(1))
    assert rows(cumulative, "item", "cumsteps") == [  # balance of a: mean(50, 90) x 3 = 210
        ("a", 260.0), ("a", 260.0), ("a", 350.0), ("b", 50.0), ("b", 50.0), ("b", 50.0),
    ]
    assert rows(steps.total_steps(cumulative), "item", "cumsteps", "rownumber") == [("a", 350.0, 1), ("b", 50.0, 2)]
