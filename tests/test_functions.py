from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helpers import one, rows
from wearlog.functions import numeric as n
from wearlog.functions import scalars as s


def values(spark, data, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")


def mapped(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_ratio_by_zero_is_unknown(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (6.0, 4.0), (None, 1.0)], "a double, b double")
    found = df.select(n.ratio("a", "b"), n.overflows("a", "b")).collect()
    assert [tuple(r) for r in found] == [(None, True), (None, False), (1.5, False), (None, False)]


def test_strict_and_loose_sums(spark):
    df = values(spark, [1.0, None, 2.0])
    assert one(df.agg(n.strict_sum("x"), n.loose_sum("x"))) == (None, 3.0)
    assert one(df.where("x > 5").agg(n.loose_sum("x"))) == (0.0,)
    assert one(df.agg(n.strict_sum_if("x", F.col("i") != 1), n.strict_sum_if("x", F.col("i") < 2))) == (3.0, None)


def test_rounding_is_half_even(spark):
    assert mapped(values(spark, [0.5, 1.5, 2.5, -2.5]), n.rounded("x")) == [0, 2, 2, -2]
    assert mapped(values(spark, [0.25, 0.35]), n.rounded("x", 1)) == [0.2, 0.4]


def test_running_sum_stops_at_unknown(spark):
    df = values(spark, [1.0, 2.0, None, 4.0])
    assert mapped(df, n.running_sum("x", W.orderBy("i"))) == [1.0, 3.0, None, None]


def test_rolling_is_empty_until_full(spark):
    df, w = values(spark, [1.0, 2.0, 3.0, 4.0]), W.orderBy("i")
    assert mapped(df, n.rolling(F.sum("x"), w, 3)) == [None, None, 6.0, 9.0]
    assert mapped(df, n.rolling(F.avg("x"), w, 3, min_rows=1)) == [1.0, 1.5, 2.0, 3.0]


def test_limits_keep_unknown(spark):
    df = values(spark, [-1.0, 200.0, None])
    assert mapped(df, n.capped("x", 150)) == [-1.0, 150.0, None]
    assert mapped(df, n.floored("x", 0)) == [0.0, 200.0, None]


@pytest.mark.parametrize(
    "price, uses, expected", [(100.0, 0.0, 100.0), (100.0, 4.0, 25.0), (None, 4.0, None), (100.0, None, None)]
)
def test_cost_per_use(spark, price, uses, expected):
    df = spark.createDataFrame([(price, uses)], "p double, u double")
    assert one(df.select(s.cost_per_use("p", "u"))) == (expected,)


def test_days_before_start(spark):
    start = dt.date(2020, 1, 1)
    df = values(spark, [dt.date(2019, 12, 22), start, dt.date(2020, 1, 5), None], "date")
    assert mapped(df, s.days_before_start("x", start)) == [10, 0, 0, None]


def test_uses_per_month(spark):
    df = spark.createDataFrame([(5.0, 0), (4.0, 61), (4.0, None)], "u double, d int")
    assert [r[0] for r in df.select(s.uses_per_month("u", "d")).collect()] == [0.0, 2.0, None]


def test_calendar_months_ignore_the_day(spark):
    df = values(spark, [dt.date(2021, 5, 31), dt.date(2021, 9, 30), dt.date(2020, 9, 1)], "date")
    assert mapped(df, s.calendar_months("x", dt.date(2021, 9, 1))) == [4, 0, 12]


AGES = [-1.0, 0.0, 1.0, 8.9, 9.0, 9.5, 10.0, 10.1, None]


def test_age_tiers_have_a_gap_unless_closed(spark):
    df = values(spark, AGES)
    assert mapped(df, s.age_tier("x")) == ["1", "1", "1", "9", "9", None, None, "Over 10", None]
    assert mapped(df, s.age_tier("x", compat=False)) == ["1", "1", "1", "9", "9", "10", "10", "Over 10", None]


def test_age_bands(spark):
    df = values(spark, [-3, 365, 366, 730, 1095, 1096, None], "int")
    expected = ["< 1 year", "< 1 year", "1-2 years", "1-2 years", "2-3 years", "3+ years", None]
    assert mapped(df, s.age_band("x")) == expected


def test_age_in_years_is_limited(spark):
    day = dt.date(2022, 9, 1)
    df = values(spark, [dt.date(2023, 1, 1), dt.date(2021, 9, 1), dt.date(1990, 1, 1), None], "date")
    assert mapped(df, s.age_years("x", day, cap=15)) == [0.0, 1.0, 15.0, None]


def test_wear_tiers(spark):
    df = values(spark, [0, 1, 3, 4, 5, 6, 20, 50, 51, None], "int")
    expected = ["0", "1", "3", "4-5", "4-5", "6-10", "11-20", "21-50", "Over 50", None]
    assert mapped(df, s.wear_tier("x")) == expected
    ranks = mapped(df, s.tier_rank(s.wear_tier("x"), s.WEAR_TIERS, s.WEAR_TIER_TOP))
    assert ranks == [1, 2, 4, 5, 5, 6, 7, 8, 9, None]


def test_labels_split_back(spark):
    df = spark.createDataFrame([("T-shirts", "Blue top")], "c string, i string")
    label = s.item_label("c", "i")
    assert one(df.select(label, s.label_category(label), s.label_item(label))) == ("T-shirts [Blue top]", "T-shirts", "Blue top")


def test_web_names(spark):
    df = spark.createDataFrame([("Photos/a b.png",)], "p string")
    assert one(df.select(s.hosted_photo("p", "https://x.test/"), s.file_slug("p"))) == (
        "https://x.test/a b.png?alt=media",
        "Photos/a_b.png",
    )


def test_flags_keep_unknown(spark):
    df = values(spark, [dt.date(2021, 9, 1), dt.date(2021, 9, 2), None], "date")
    assert mapped(df, s.after("x", dt.date(2021, 9, 1))) == [False, True, None]
    assert rows(values(spark, [0.0, 3.0]).select(s.effective_wears("x").alias("w"))) == [(1.0,), (3.0,)]
