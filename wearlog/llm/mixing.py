"""Mix sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. *Targets.* Sources share the words of all documents by weight; a target stops at ``most`` times
   its source's size, and what is left over is shared again by weight among the others.
2. *Quotas.* The mix is a number of blocks of ``block`` words. Each source gets as many as the
   Sainte-Laguë method gives it: seats go to the highest quotients ``target / (2 k + 1)``. The
   documents of a source are dealt by a hash into shards, one for every ``shard_words`` words of the
   source itself, so that also a small source has few short last blocks; the source's blocks are
   apportioned to its shards in the same way.
3. *Selection.* The documents of a source's shard, by id, form a row of blocks. A quota of several
   times the number of blocks takes all of them as often; the rest takes the blocks with the
   smallest seeded hash. A document is taken as often as the blocks that cover its words.

No step gathers a source: totals are partial sums, and rows of documents are numbered within shards,
whose size does not depend on how large a source is. Only a row for each source, and for each shard
of a source, is ranked.

Behaviour: a null or empty text has size 0, and nothing of it is taken. Null sources are one source,
last in the order. Repeated rows are documents of their own; which of two equal rows stands first in
a shard does not matter to the numbers taken in all. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog.operators.joins import join_null_safe
from wearlog.sources.storage import materialised

BLOCK = 128
SHARD_WORDS = 1 << 20
#: Fixed value: a word, everything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """Per source: source_size and target. A row for each source is ordered in one task."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy(F.lit(0))
    ordered = every.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    sources = sources.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * float(most))
    # Sources whose cap comes first as the common level rises are the ones that stop there.
    by_level = every.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    sources = sources.withColumn("_level", left / F.sum("_weight").over(after))
    # A level holds if all sources before it stop; the first source that does not stop sets it.
    goes_on = F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), F.col("_level"))
    level = F.first(goes_on, ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return sources.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(level * F.col("_weight"), F.col("_cap"))).alias("target"))


def sainte_lague(parties: DataFrame, group: Sequence[str], party: Sequence[str], weight: str, seats: str, most: str) -> DataFrame:
    """Add ``quota``: each party's share of the group's ``seats``, at most ``most`` of them.

    Seats go to the highest quotients weight / (2 k + 1); ties go to the party first in order. A
    party surely has most of its seats, so only the quotients near its share are ranked: about two
    rows a party. Parties of no weight get none.
    """
    of_group = W.partitionBy(*[F.col(g) for g in group]) if group else W.partitionBy(F.lit(0))
    able = F.when(F.col(weight) > 0, F.col(weight).cast("double"))
    share = able / F.sum(able).over(of_group)
    half = F.count(able).over(of_group) / 2
    few = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - half) - 0.5) - 1)
    many = F.floor(share * (F.col(seats) + half) + 0.5) + 3
    bounds = parties.withColumn("_few", F.least(F.coalesce(few, F.lit(0)), F.col(most)).cast("long"))
    bounds = bounds.withColumn("_many", F.least(F.coalesce(many, F.lit(0)), F.col(most)).cast("long"))
    bounds = bounds.withColumn("_open", F.col(seats) - F.sum("_few").over(of_group))
    ranked = bounds.withColumn("_k", F.explode_outer(F.when(F.col("_many") > F.col("_few"), F.sequence("_few", F.col("_many") - 1))))
    quotient = F.col(weight) / (2 * F.col("_k") + 1)
    order = of_group.orderBy(quotient.desc_nulls_last(), *[F.col(p).asc_nulls_last() for p in party], "_k")
    won = F.col("_k").isNotNull() & (F.row_number().over(order) <= F.col("_open"))
    return (
        ranked.withColumn("_won", won)
        .groupBy(*parties.columns)
        .agg((F.min("_few") + F.count(F.when(F.col("_won"), 1))).alias("quota"))
    )


def _rank(seed: int, block: Column) -> Column:
    """Seeded hash of a block of a source's shard."""
    return F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull(), "shard", block)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    most: int = 3,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, whole, blocks.

    ``whole`` is how often the whole document is taken, ``blocks`` lists further ranges of its words
    (first, behind the last).
    """
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    sizes = materialised(sizes, "sizes")
    targets = materialised(source_targets(sizes, weights, most), "targets")
    shards = targets.select("source", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("_shards"))
    dealt = join_null_safe(sizes, shards, ["source"]).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("_shards"))).drop("_shards")

    parts = dealt.groupBy("source", "shard").agg(F.sum("size").alias("part_size"))
    parts = materialised(parts.withColumn("n_blocks", F.ceil(F.col("part_size") / block)), "parts")
    # A source wants so many seats that they hold its target: the last block of a part is a short one.
    wanted = join_null_safe(targets, parts.groupBy("source").agg(F.sum("n_blocks").alias("_blocks")), ["source"])
    wanted = wanted.withColumn("_wanted", F.when(F.col("source_size") > 0, F.col("target") * F.col("_blocks") / F.col("source_size")).otherwise(0.0))
    wanted = materialised(wanted, "wanted")
    total = wanted.agg(F.sum("_wanted")).first()[0] or 0
    seats = wanted.withColumns({"_seats": F.round(F.lit(total)).cast("long"), "_most": most * F.col("_blocks")})
    of_source = sainte_lague(seats, [], ["source"], "_wanted", "_seats", "_most").select("source", F.col("quota").alias("_seats"))
    parts = join_null_safe(parts, of_source, ["source"])
    parts = parts.withColumn("_most", most * F.col("n_blocks"))
    quotas = sainte_lague(parts, ["source"], ["shard"], "n_blocks", "_seats", "_most")
    quotas = quotas.withColumn("whole", F.when(F.col("n_blocks") > 0, F.floor(F.col("quota") / F.col("n_blocks"))).otherwise(0))
    quotas = materialised(quotas.withColumn("more", F.col("quota") - F.col("whole") * F.col("n_blocks")), "quotas")

    # The largest hash among the blocks that are taken once more.
    chosen = quotas.where("more > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    chosen = chosen.select("source", "shard", "more", _rank(seed, F.col("block")).alias("rank"))
    nth = F.row_number().over(W.partitionBy("source", "shard").orderBy("rank"))
    limits = chosen.withColumn("_n", nth).where("_n = more").select("source", "shard", F.col("rank").alias("last_rank"))
    plan = join_null_safe(quotas.select("source", "shard", "whole"), limits, ["source", "shard"], "left")

    row = W.partitionBy("source", "shard").orderBy("doc_id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(row.rowsBetween(W.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    placed = join_null_safe(join_null_safe(placed, plan, ["source", "shard"]), targets, ["source"])
    covering = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).otherwise(F.array().cast("array<bigint>"))
    taken_blocks = F.filter(covering, lambda b: F.col("last_rank").isNotNull() & (_rank(seed, b) <= F.col("last_rank")))
    ranges = F.transform(
        taken_blocks,
        lambda b: F.struct(
            (F.greatest(b * block, F.col("begin")) - F.col("begin")).alias("first"),
            (F.least((b + 1) * block, F.col("end")) - F.col("begin")).alias("behind"),
        ),
    )
    placed = placed.withColumn("blocks", ranges)
    once_more = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, r: n + r["behind"] - r["first"])
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + once_more).cast("long").alias("taken"),
        F.col("whole").cast("long").alias("whole"),
        "blocks",
    )
