"""Exact ranks, quantiles and concentration for groups of any size.

A plain ``row_number`` or ``percentile`` brings a whole group into one task. When one
user or category holds a large share of all rows, that task decides the run time, or
fails. The operators here give the same results from pieces of bounded size:

* values are first counted, so copies collapse before the first shuffle;
* the distinct values of a group are cut into order-preserving buckets, and only the
  bucket totals are accumulated per group;
* rank listings over arbitrary sort keys use one range-partitioned sort.

Where groups are small, as one category on one date, those pieces cost several shuffles of
all rows. ``large_groups`` tells the groups that need them; a window serves the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog.functions.numeric import rounded
from wearlog.operators.joins import join_null_safe
from wearlog.sources.storage import materialised

BUCKETS_PER_DOUBLING = 1024
_EXPONENT_SHIFT = 1100  # makes every binary exponent of a double positive
WINDOW_ROWS = 1_000_000  # rows that a task may well hold as one group


def order_bucket(value: Column) -> Column:
    """Whole number that never decreases with the value.

    Each power of two is cut into equal steps, so a bucket spans at most 0.1 % of the
    value and small whole numbers have a bucket of their own. A group therefore has at
    most a few ten thousand buckets in any realistic range of prices or counts.
    """
    size = F.least(F.abs(value), F.lit(1e300))
    exponent = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * BUCKETS_PER_DOUBLING)
    bucket = (exponent + _EXPONENT_SHIFT) * BUCKETS_PER_DOUBLING + step
    return F.when(value == 0, F.lit(0)).when(value > 0, bucket).otherwise(-bucket).cast("long")


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group and distinct value: how many rows have it, come before it, and exist.

    Columns: keys, ``value``, ``n_here``, ``n_before``, ``n_total``. Unknown values are
    left out.
    """
    # Keys travel as one struct, which is never null itself: groups with a null key join, and
    # one partitioning by group and bucket serves both the join and the window after it.
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    counted = (
        df.select(group.alias("_group"), F.col(value).cast("double").alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("_group", "value")
        .agg(F.count(F.lit(1)).alias("n_here"))
        # Declared non-null, so that the join adds no filter and both branches share the shuffle.
        .withColumn("_bucket", F.coalesce(order_bucket(F.col("value")), F.lit(0).cast("long")))
    )
    of_group = W.partitionBy("_group")
    below = of_group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        counted.groupBy("_group", "_bucket")
        .agg(F.sum("n_here").alias("_n"))
        .withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        .withColumn("n_total", F.sum("_n").over(of_group))
        .drop("_n")
    )
    in_bucket = W.partitionBy("_group", "_bucket").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    return counted.join(totals, ["_group", "_bucket"]).select(
        *[F.col("_group")[k].alias(k) for k in keys],
        "value",
        "n_here",
        (F.col("_below") + F.coalesce(F.sum("n_here").over(in_bucket), F.lit(0))).alias("n_before"),
        "n_total",
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per named probability."""
    positions = value_positions(df, keys, value)
    last = F.max("n_total") - 1

    picks, results = [], []
    for name, p in probabilities.items():
        spot = F.lit(float(p)) * (F.col("n_total") - 1)
        for side, index in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            covers = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n_here"))
            picks.append(F.max(F.when(covers, F.col("value"))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        weight = F.lit(float(p)) * F.col("_last") - F.floor(F.lit(float(p)) * F.col("_last"))
        results.append((lo + weight * (hi - lo)).alias(name))
    return positions.groupBy(*keys).agg(last.alias("_last"), *picks).select(*keys, *results)


def with_group_median(summary: DataFrame, df: DataFrame, keys: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Add medians to a grouped summary: ``values`` maps new column -> measured column."""
    for name, value in values.items():
        medians = exact_quantiles(df, keys, value, {name: 0.5})
        summary = join_null_safe(summary, medians, keys, "left")
    return summary


def gini(df: DataFrame, keys: Sequence[str], value: str, unbiased: bool = True, digits: int | None = None) -> DataFrame:
    """Concentration of a non-negative measure per group.

    Rows in ascending order have ranks 1..n; a distinct value that covers several ranks
    contributes its value times the sum of those ranks, so no row is ever numbered.
    One row has no unbiased index; a group that sums to 0 has none at all.
    """
    c, before, x = F.col("n_here").cast("double"), F.col("n_before").cast("double"), F.col("value")
    rank_sum = c * before + c * (c + 1) / 2
    grouped = (
        value_positions(df, keys, value)
        .groupBy(*keys)
        .agg(
            F.sum(x * rank_sum).alias("_weighted"),
            F.sum(x * c).alias("_total"),
            F.max("n_total").cast("double").alias("_n"),
        )
    )
    n = F.col("_n")
    biased = F.try_divide(2 * F.col("_weighted"), n * F.col("_total")) - (n + 1) / n
    index = biased * F.try_divide(n, n - 1) if unbiased else biased
    index = F.when(index < 0, F.lit(0.0)).otherwise(index)
    return grouped.select(*keys, (index if digits is None else rounded(index, digits)).alias("gini"))


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """1-based row number within a group, for groups that need not fit into one task.

    The rows are sorted once by range partitioning over keys and sort columns, which cuts
    a large group wherever its sort values allow. Slots are fixed by a written table, since
    a recomputed range partitioning may cut differently; the row number then follows from
    the number of rows of the group in the partitions before. Callers hand in the columns
    that they need and no others.
    """
    keys = list(keys)
    placed = df.orderBy(*keys, *order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_slot")
    )
    slots = materialised(placed, "ranked")
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        slots.groupBy(*keys, "_part")
        .agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    return (
        join_null_safe(slots, offsets, [*keys, "_part"])
        .withColumn(name, F.col("_before") + F.col("_slot") - F.col("_first") + 1)
        .drop("_slot", "_part", "_first", "_before")
    )


def large_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The groups that should not be one task's work, those of over WINDOW_ROWS rows; None if there are none.

    Partial sums come before the shuffle, so this is cheap where ``keys`` are coarse. The rows are
    read here and by the caller again.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WINDOW_ROWS)
    found = materialised(counted.drop("_n"), "large")
    return None if found.isEmpty() else found
