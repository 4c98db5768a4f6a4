"""K-d tree sharding: leaves of near equal bytes, split along the widest metadata dimension.

Metadata of a document, all derived from its text: bytes, bytes beyond one a character (accents tell
languages apart), and lines. A node of the tree that is to become k shards is split along the
dimension that is widest in it (logarithmic, relative to the whole table), at the weighted quantile
that leaves floor(k / 2) of k shards' bytes on the left. Ties within a dimension are ordered by the
checksum of the text, so equal texts stay in one shard, unless they alone outweigh the tolerance
where a cut falls; then the cut goes through them by a hash of the id.

*Distributed quantiles.* All nodes of a level are cut at the same time. A round sums bytes in 1024
ranges of each node's key and descends into the range that holds the cut, until that range weighs
less than the tolerance. Only these sums come to the driver: 1024 rows a node, and at most as many
nodes as shards. The tree is then one expression over the row.

*Slots.* Rows of a shard are numbered from 0 within parts of bounded size, in a hash's order, and a
sum over parts.

The law is ``bytes``: shards weigh nearly the same. Row counts may differ.

Behaviour: a null text weighs ``overhead`` bytes and has a null checksum. Repeated rows are rows of their
own. Null ids are placed like any other. With fewer texts than shards some shards are empty. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog.sources.storage import materialised

DIMENSIONS = ("n_bytes", "beyond", "n_lines")
OVERHEAD = 8
RANGES = 1024
TOLERANCE = 0.0005
PART_ROWS = 20_000
_TIE = 1 << 32
_IDS = 1 << 20


@dataclass
class Node:
    """Part of the table that becomes shards ``first`` to ``first + shards - 1``."""

    first: int
    shards: int
    where: Column
    dimension: str = ""
    goal: float = 0.0
    low: int = 0
    high: int = 0
    below: float = 0.0
    by_id: bool = False
    done: bool = False
    key: int = 0


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Narrow table: doc_id, size, text_crc32, spot (hash of the id), a key for each dimension."""
    t = F.col(text)
    n_bytes, chars = F.octet_length(t), F.length(t)
    lines = chars - F.length(F.translate(t, "\n", ""))
    crc = F.crc32(F.encode(t, "UTF-8"))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(n_bytes, F.lit(0)) + overhead).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(doc_id)), F.lit(_IDS)).cast("long").alias("spot"),
        *[F.coalesce(value, F.lit(0)).cast("long").alias(f"_{name}") for name, value in zip(DIMENSIONS, (n_bytes, n_bytes - chars, lines))],
    )
    tie = F.coalesce("text_crc32", F.lit(0))
    return narrow.select("doc_id", "size", "text_crc32", "spot", *[(F.col(f"_{d}") * _TIE + tie).alias(d) for d in DIMENSIONS])


def _which(nodes: list[Node]) -> Column:
    """Index of the row's node; null if it is in none."""
    number = F.lit(None).cast("int")
    for i, node in enumerate(nodes):
        number = F.when(node.where, F.lit(i)).otherwise(number)
    return number


def _by_node(nodes: list[Node], value) -> Column:
    """A value of the row's node, given its index in ``_node``."""
    return F.element_at(F.array(*[F.lit(value(n)) for n in nodes]), F.col("_node") + 1)


def _width(low: int, high: int) -> float:
    """Logarithmic width of a range of keys."""
    return log2(1 + high // _TIE) - log2(1 + low // _TIE)


def _cut(table: DataFrame, nodes: list[Node], tolerance: float) -> None:
    """Find the key (and hash of ids, within a key) at which each node is cut."""
    wide = [F.min(d).alias(f"min_{d}") for d in DIMENSIONS] + [F.max(d).alias(f"max_{d}") for d in DIMENSIONS]
    of_node = table.withColumn("_node", _which(nodes)).where("_node is not null")
    whole = {r._node: r for r in of_node.groupBy("_node").agg(F.sum("size").alias("size"), *wide).collect()}
    span = {d: max(1e-9, _width(min(r[f"min_{d}"] for r in whole.values()), max(r[f"max_{d}"] for r in whole.values()))) for d in DIMENSIONS} if whole else {}
    for i, node in enumerate(nodes):
        if (r := whole.get(i)) is None:
            node.done, node.dimension = True, DIMENSIONS[0]
            continue
        node.dimension = max(DIMENSIONS, key=lambda d: _width(r[f"min_{d}"], r[f"max_{d}"]) / span[d])
        node.goal = r.size * (node.shards // 2) / node.shards
        node.low, node.high = r[f"min_{node.dimension}"], r[f"max_{node.dimension}"] + 1
    while open_nodes := [n for n in nodes if not n.done]:
        key = F.lit(None).cast("long")
        for i, n in enumerate(open_nodes):
            own = F.when(F.col(n.dimension) == n.key, F.col("spot")) if n.by_id else F.col(n.dimension)
            key = F.when(F.col("_node") == i, own).otherwise(key)
        rows = table.withColumn("_node", _which(open_nodes)).where("_node is not null").withColumn("_key", key)
        low, high = _by_node(open_nodes, lambda n: n.low), _by_node(open_nodes, lambda n: n.high)
        step = F.ceil((high - low) / RANGES)
        ranged = rows.where((F.col("_key") >= low) & (F.col("_key") < high)).withColumn("_range", F.floor((F.col("_key") - low) / step))
        sums: dict[int, list] = {}
        found = ranged.groupBy("_node", "_range").agg(F.sum("size").alias("size"), F.min("_key").alias("least"), F.max("_key").alias("most"))
        for r in found.collect():
            sums.setdefault(r._node, []).append((r.least, r.most, r.size))
        for i, n in enumerate(open_nodes):
            for least, most, size in sorted(sums.get(i, [])):
                if n.below + size >= n.goal:
                    n.low, n.high = least, most + 1
                    if size <= tolerance:
                        # The nearer edge of a range that weighs little.
                        n.done = True
                        n.low = n.high if n.below + size - n.goal < n.goal - n.below else n.low
                    elif n.high - n.low == 1 and not n.by_id:
                        n.key, n.by_id, n.low, n.high = n.low, True, 0, _IDS
                    elif n.high - n.low == 1:
                        n.done = True
                        n.low = n.high if n.below + size - n.goal < n.goal - n.below else n.low
                    break
                n.below += size
            else:
                n.low, n.done = n.high, True


def _left(node: Node) -> Column:
    if node.by_id:
        key = F.col(node.dimension)
        return (key < node.key) | ((key == node.key) & (F.col("spot") < node.low))
    return F.col(node.dimension) < node.low


def shard(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    table = materialised(describe(docs, doc_id, text, overhead), "metadata")
    facts = table.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    level, leaves = [Node(0, shards, F.lit(True))], []
    while level:
        split = [n for n in level if n.shards > 1]
        leaves += [n for n in level if n.shards == 1]
        if split:
            _cut(table, split, tolerance * (facts.size or 0) / shards)
        level = []
        for n in split:
            left, few = _left(n), n.shards // 2
            level.append(Node(n.first, few, n.where & left))
            level.append(Node(n.first + few, n.shards - few, n.where & ~left))
    number = F.lit(None).cast("int")
    for n in leaves:
        number = F.when(n.where, F.lit(n.first)).otherwise(number)
    placed = table.withColumn("shard", number)
    parts = int(max(1, facts.n // (shards * PART_ROWS)))
    placed = materialised(placed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts))), "placed")
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("_row", within).join(offsets, ["shard", "_part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
