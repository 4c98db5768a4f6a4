"""Skew-safe ranks and quantiles against plain computation, also with one dominant group."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from wearlog.operators import cowear, ordered
from wearlog.operators.joins import join_null_safe


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, and half of its values are copies of 0; one key is null."""
    rng = random.Random(7)
    data = [("hot", 0.0 if rng.random() < 0.5 else round(rng.lognormvariate(3, 2), 2)) for _ in range(3000)]
    data += [(f"k{i % 5}", float(rng.randint(-20, 20))) for i in range(400)] + [(None, 1.0), (None, 2.0), ("empty", None)]
    return spark.createDataFrame([(k, v, f"row {i}") for i, (k, v) in enumerate(data)], "k string, v double, id string")


def test_quantiles_match_plain_ones(skewed):
    probabilities = {"p05": 0.05, "p32": 0.32, "p50": 0.5, "p100": 1.0}
    found = {r.k: tuple(r)[1:] for r in ordered.exact_quantiles(skewed, ["k"], "v", probabilities).collect()}
    groups = {}
    for k, v in skewed.select("k", "v").where("v is not null").collect():
        groups.setdefault(k, []).append(v)
    assert set(found) == set(groups)
    for k, values in groups.items():
        assert found[k] == pytest.approx(tuple(np.quantile(values, list(probabilities.values()))))


def test_positions_count_every_row_once(skewed):
    positions = ordered.value_positions(skewed, ["k"], "v")
    assert positions.agg(F.sum("n_here")).first()[0] == skewed.where("v is not null").count()
    gaps = positions.groupBy("k").agg((F.max(F.col("n_before") + F.col("n_here")) - F.max("n_total")).alias("gap"))
    assert {r.gap for r in gaps.collect()} == {0}


def test_row_positions_match_row_number(spark, skewed):
    from pyspark.sql import Window as W

    order = [F.desc_nulls_last("v"), F.col("id").asc()]
    found = ordered.row_positions(skewed, ["k"], order, "n")
    plain = skewed.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy(*order)))
    assert found.count() == skewed.count() and found.exceptAll(plain.select(*found.columns)).count() == 0


def test_row_positions_hold_when_the_table_changes_its_layout(skewed):
    """The result is fixed once made: reading it twice gives the same numbers."""
    found = ordered.row_positions(skewed, ["k"], ["v", "id"], "n")
    assert found.exceptAll(found.repartition(7)).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=2, max_size=60))
def test_buckets_keep_the_order(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = sorted((tuple(r) for r in df.select("v", ordered.order_bucket(F.col("v"))).collect()), key=lambda r: r[0])
    assert all(a[1] <= b[1] for a, b in zip(found, found[1:]))


def test_buckets_at_powers_of_two(spark):
    edges = [2.0**e for e in range(-30, 40)]
    values = sorted(v for e in edges for v in (math.nextafter(e, 0), e, math.nextafter(e, math.inf)))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = sorted(tuple(r) for r in df.select("v", ordered.order_bucket(F.col("v"))).collect())
    assert all(a[1] <= b[1] for a, b in zip(found, found[1:]))


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, y int")
    assert rows(join_null_safe(left, right, ["k"])) == [(None, 1, 10)]
    assert rows(join_null_safe(left, right, ["k"], "left")) == [(None, 1, 10), ("a", 2, None)]


def brute_pairs(baskets):
    counts = {}
    for user, _, items in baskets:
        items = sorted(set(items))
        for i, a in enumerate(items):
            for b in items[i + 1 :]:
                counts[user, a, b] = counts.get((user, a, b), 0) + 1
    return sorted((*k, v) for k, v in counts.items())


@pytest.mark.parametrize("chunk", [256, 4, 1])
def test_pairs_match_brute_force(spark, chunk):
    """Ordinary days and one with many items; chunk sizes do not change the counts."""
    rng = random.Random(3)
    baskets = [("u1", f"2020-01-{d:02d}", [f"i{rng.randint(0, 9)}" for _ in range(d % 5)]) for d in range(1, 20)]
    baskets += [("u2", "2020-01-01", [f"i{i}" for i in range(23)]), ("u2", "2020-01-02", ["i1", "i2", "i2"])]
    used = spark.createDataFrame([(u, d, i) for u, d, items in baskets for i in items], "user string, date string, item string")
    found = sorted(tuple(r) for r in cowear.cowear_pairs(used, chunk_items=chunk).select("user", "from", "to", "weight").collect())
    assert found == brute_pairs(baskets)


@pytest.mark.parametrize("kind", ["date", "int", "string"])
@pytest.mark.parametrize("often,chunk", [(8, 256), (8, 3), (1, 4), (65, 4)])
def test_pairs_by_bits_match_brute_force(spark, kind, often, chunk):
    """Often and rarely used items over several words of days, before and after day 0."""
    rng = random.Random(5)
    share = [0.9, 0.7, 0.5, 0.3, 0.12, 0.1, 0.03, 0.02]
    baskets = [("u1", d, [f"i{k}" for k, p in enumerate(share) if rng.random() < p]) for d in range(-70, 130)]
    baskets += [("u2", 63, ["i0", "i1", "i1"]), ("u2", 64, ["i0", "i1", "i7"])]
    entries = [(u, d, i) for u, d, items in baskets for i in items] + [("u2", None, "i0"), ("u2", None, "i1"), ("u2", 63, None)]
    used = spark.createDataFrame(entries, "user string, day int, item string")
    date = {"date": F.date_from_unix_date("day"), "int": F.col("day"), "string": F.col("day").cast("string")}[kind]
    found = cowear.cowear_pairs(used.select("user", date.alias("date"), "item"), chunk_items=chunk, often=often)
    assert sorted(tuple(r) for r in found.select("user", "from", "to", "weight").collect()) == brute_pairs(baskets)


def test_often_used_items_meet_once_for_64_days(spark):
    used = spark.range(640).selectExpr("'u' as user", "cast(id as int) as date", "explode(sequence(1, 12)) as item")
    parts = cowear.partial_pairs(used)
    assert parts.count() == 66 * 10 and {r.weight for r in parts.collect()} == {64}
    assert cowear.partial_pairs(used, often=65).count() == 66 * 640


def test_forms_and_pairs(spark):
    forms = spark.createDataFrame(
        [("t", "2020-01-01", "Used today", "Used twice", None), ("t", "2020-01-02", "Used today", None, "Washed"), ("t", None, "Used", None, None)],
        "Timestamp string, `Diary entry date` string, `Shirts [Blue top]` string, `Pants [Jeans]` string, `Hats [Cap]` string",
    )
    used = cowear.used_by_date(forms)
    assert rows(used) == [("2020-01-01", "Pants [Jeans]"), ("2020-01-01", "Shirts [Blue top]"), ("2020-01-02", "Shirts [Blue top]")]
    assert rows(cowear.used_by_date(forms, exclude_categories=["Shirts"])) == [("2020-01-01", "Pants [Jeans]")]
    items = spark.createDataFrame([("Shirts", "Blue top"), ("Pants", "Jeans"), ("Pants", "Jeans old")], "category string, item string")
    assert rows(cowear.unknown_items(used, items, keys=[])) == []
    assert rows(cowear.unknown_items(used, items.where("category = 'Pants'"), keys=[])) == [("Shirts [Blue top]",)]
    pairs = cowear.cowear_pairs(used, keys=[])
    split = cowear.split_pairs(pairs, keys=[])
    assert rows(split) == [("Pants", "Jeans", "Shirts", "Blue top", 1)]
    assert rows(cowear.index_pairs(split, cowear.item_index(items, keys=[]), keys=[])) == [("Pants", 1, "Shirts", 1, 1)]
    assert rows(cowear.pairs_of(split, "Pants"), "scaled_weight") == [(1.0,)]
    assert rows(cowear.pairs_of(split, "Hats")) == []


def test_same_name_in_two_categories_gets_its_own_number(spark):
    items = spark.createDataFrame(
        [("u", "Shirts", "Blue"), ("u", "Shirts", "Azure"), ("u", "Pants", "Blue")], "user string, category string, item string"
    )
    assert rows(cowear.item_index(items), "category", "item", "item_index") == [
        ("Pants", "Blue", 1), ("Shirts", "Azure", 1), ("Shirts", "Blue", 2),
    ]
