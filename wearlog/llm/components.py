"""Connected components of a link table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearlog.sources.storage import discard, materialised


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node of every node that has a link: columns ``node``, ``component``.

    Every round hangs each node's larger neighbours, then its smaller ones, on the smallest
    node of its neighbourhood. Links become stars in a number of rounds that grows with the
    logarithm of the longest chain. Each round is written to the shared folder, which keeps
    plans short and survives lost executors. Null ends and links to oneself are left out.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges, before = materialised(edges.distinct(), "links"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        roots = least.where("m < u").select("u", F.col("m").alias("v"))
        hung = large.union(roots).where("u != v").distinct()
        down = hung.groupBy("u").agg(F.min("v").alias("m"))
        small = hung.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = materialised(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(edges)
        edges = hung
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                roots.select("node", F.col("node").alias("component"))
            )
        before = now
