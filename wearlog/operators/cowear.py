"""Items worn on the same day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearlog import defaults
from wearlog.functions.numeric import ratio
from wearlog.functions.scalars import item_label, label_category, label_item
from wearlog.operators.ordered import row_positions

CHUNK_ITEMS = 256
SPREAD = 8
#: Days that are the bits of one number.
WORD_DAYS = 64
#: Days of a word from which two items share one on average.
OFTEN = 8


def used_by_date(
    responses: DataFrame,
    date: str = defaults.FORM_DATE,
    keys: Sequence[str] = (),
    dropped: Sequence[str] = (defaults.FORM_TIMESTAMP,),
    exclude_categories: Sequence[str] = (),
    mark: str = defaults.USED_MARK,
) -> DataFrame:
    """Items marked as used on each form, one row per date and ``category [item]`` column."""
    known = {date, *keys, *dropped}
    labels = [c for c in responses.columns if c not in known]
    rows = responses.where(F.col(f"`{date}`").isNotNull()).select(
        *keys, F.col(f"`{date}`").alias("date"), *[F.col(f"`{c}`") for c in labels]
    )
    used = (
        rows.unpivot([*keys, "date"], [F.col(f"`{c}`") for c in labels], "item", "used")
        .where(F.col("used").contains(mark))
        .select(*keys, "date", "item")
    )
    if exclude_categories:
        used = used.where(~F.regexp_extract("item", r"^(.*?) \[", 1).isin(*exclude_categories))
    return used


def labelled_use(use: DataFrame) -> DataFrame:
    """Used items of a daily log in the form that the forms give."""
    return use.where("used").select("user", "date", item_label("category", "item").alias("item"))


def unknown_items(used: DataFrame, items: DataFrame, keys: Sequence[str] = ("user",)) -> DataFrame:
    """Used labels that the item list does not have; empty on clean data."""
    listed = items.select(*keys, item_label("category", "item").alias("item"))
    return used.select(*keys, "item").distinct().join(listed, [*keys, "item"], "left_anti")


def _day_words(used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per item and 64 consecutive days: the days used as the bits of a number.

    Columns: keys, ``_word``, ``item``, ``_days``. Days without an order of their own (neither dates
    nor whole numbers) have a row each.
    """
    kind = used.schema["date"].dataType
    if isinstance(kind, (T.DateType, T.IntegralType)):
        number = (F.unix_date("date") if isinstance(kind, T.DateType) else F.col("date")).cast("long")
    else:
        number = None
    word = F.col("date") if number is None else F.floor(number / WORD_DAYS)
    bit = F.lit(0) if number is None else F.pmod(number, F.lit(WORD_DAYS)).cast("int")
    rows = used.where("date is not null and item is not null").select(*keys, "item", word.alias("_word"), bit.alias("_bit"))
    return rows.groupBy(*keys, "_word", "item").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_days"))


def _meetings(entries: DataFrame, group: Sequence[str], chunk_items: int) -> DataFrame:
    """Pairs (``_a``, ``_b``) of a group's items, without the pairs of two ``_often`` items.

    A group with many items is cut into chunks by item hash, and each pair of chunks is a join key
    of its own: no task gets more than ``chunk_items`` squared combinations of one group. Often used
    items have chunks of their own, behind the others, and such chunks never meet each other.
    """
    group, often = list(group), F.col("_often")
    chunks = lambda some: F.ceil(F.count_if(some) / F.lit(float(chunk_items)))
    sizes = entries.groupBy(*group).agg(chunks(~often).alias("_rare"), chunks(often).alias("_more")).where("_rare > 0")
    # The number of chunks is looked up in parts, so that a group with very many items is no single key.
    spot = F.pmod(F.xxhash64("item"), F.lit(SPREAD)).cast("long").alias("_spot")
    spread = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("_spot"))
    placed = entries.select("*", spot).join(spread, [*group, "_spot"])
    within = F.when(often, F.col("_rare") + F.pmod(F.xxhash64("item"), F.col("_more"))).otherwise(F.pmod(F.xxhash64("item"), F.col("_rare")))
    placed = placed.withColumn("_chunk", within)
    left = placed.where(~often).select(
        *group,
        F.col("item").alias("_a"),
        F.col("_days").alias("_days_a"),
        F.col("_chunk").alias("_first"),
        F.explode(F.sequence(F.col("_chunk"), F.col("_rare") + F.col("_more") - 1)).alias("_second"),
    )
    right = placed.select(
        *group,
        F.col("item").alias("_b"),
        F.col("_days").alias("_days_b"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.least("_chunk", F.col("_rare") - 1))).alias("_first"),
        F.col("_chunk").alias("_second"),
    )
    return left.join(right, [*group, "_first", "_second"]).where((F.col("_first") < F.col("_second")) | (F.col("_a") < F.col("_b")))


def partial_pairs(used: DataFrame, keys: Sequence[str] = ("user",), chunk_items: int = CHUNK_ITEMS, often: int = OFTEN) -> DataFrame:
    """Parts of the counts of ``cowear_pairs``: several rows a pair, whose weights add up.

    An item is at each of its days, and if it is often used also once at the whole word of days.
    """
    keys = list(keys)
    often_used = F.bit_count("_days") >= often
    entry = lambda bit, days, often: F.struct(bit.alias("_bit"), days.alias("_days"), often.alias("_often"))
    whole = F.array(entry(F.lit(-1), F.col("_days"), F.lit(False)))
    used_bits = F.filter(F.sequence(F.lit(0), F.lit(WORD_DAYS - 1)), lambda bit: F.getbit("_days", bit) == 1)
    single = F.transform(used_bits, lambda bit: entry(bit, F.lit(1).cast("long"), often_used))
    places = F.explode(F.when(often_used, F.concat(whole, single)).otherwise(single)).alias("_at")
    entries = _day_words(used, keys).select(*keys, "_word", "item", places).select(*keys, "_word", "item", "_at.*")
    shared = F.bit_count(F.col("_days_a").bitwiseAND(F.col("_days_b"))).cast("long")
    met = _meetings(entries, [*keys, "_word", "_bit"], chunk_items).withColumn("weight", shared).where("weight > 0")
    return met.select(*keys, F.least("_a", "_b").alias("from"), F.greatest("_a", "_b").alias("to"), "weight")


def cowear_pairs(used: DataFrame, keys: Sequence[str] = ("user",), chunk_items: int = CHUNK_ITEMS, often: int = OFTEN) -> DataFrame:
    """Number of dates on which two items were worn together.

    The result is one row per pair that ever occurs, so items have to meet. Two items that are each
    used on ``often`` of 64 days meet once for all of these days, as numbers with a bit a day: what
    both have is counted bitwise. From 8 days on such items share a day on average, so this makes
    fewer rows than meeting day by day, up to 64 times fewer. All other pairs meet on the days
    themselves. Counts are added in place before anything is shuffled. Rows without date or item
    are in no pair.
    """
    parts = partial_pairs(used, keys, chunk_items, often)
    return parts.groupBy(*keys, "from", "to").agg(F.sum("weight").alias("weight"))


def split_pairs(pairs: DataFrame, keys: Sequence[str] = ("user",)) -> DataFrame:
    """Pairs with category and item of both ends in columns of their own."""
    return pairs.select(
        *keys,
        label_category("from").alias("cat_1"),
        label_item("from").alias("item_1"),
        label_category("to").alias("cat_2"),
        label_item("to").alias("item_2"),
        "weight",
    )


def top_pairs(pairs: DataFrame, n: int = 10, strongest: bool = True) -> DataFrame:
    weight: Column = F.col("weight").desc() if strongest else F.col("weight").asc()
    return pairs.orderBy(weight, *[c for c in pairs.columns if c != "weight"]).limit(n)


def pairs_of(split: DataFrame, category: str) -> DataFrame:
    """Pairs that touch a category, with their weight relative to the strongest one."""
    found = split.where((F.col("cat_1") == category) | (F.col("cat_2") == category))
    return found.withColumn("scaled_weight", ratio("weight", found.select(F.max("weight")).scalar()))


def item_index(items: DataFrame, keys: Sequence[str] = ("user",)) -> DataFrame:
    """Items numbered within their category."""
    listed = items.select(*keys, "category", "item").distinct()
    return row_positions(listed, [*keys, "category"], [F.col("item").asc()], "item_index")


def index_pairs(split: DataFrame, index: DataFrame, keys: Sequence[str] = ("user",)) -> DataFrame:
    """Pairs with item numbers instead of names, matched by category and item."""
    keys = list(keys)
    for side in ("1", "2"):
        numbers = index.select(
            *keys,
            F.col("category").alias(f"cat_{side}"),
            F.col("item").alias(f"item_{side}"),
            F.col("item_index").alias(f"index_{side}"),
        )
        split = split.join(numbers, [*keys, f"cat_{side}", f"item_{side}"])
    return split.select(*keys, "cat_1", "index_1", "cat_2", "index_2", "weight")


def category_counts(items: DataFrame, dim: DataFrame) -> DataFrame:
    """Items per category of the dimension; an empty category counts as one."""
    counts = items.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
    return dim.select("category", "rank").join(counts, "category", "left").select(
        "category", "rank", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).alias("items")
    )
