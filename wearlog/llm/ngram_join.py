"""Jaccard join on word n-grams: rare-first prefixes, length, positional and suffix filters.

Every text becomes the set of its distinct n-word sequences (hashed to 64 bits). Two texts link
when the intersection is at least ``percent`` hundredths of the union.

1. *Sets.* Texts with equal sets are one node, so copies are never compared with each other.
2. *Order.* All n-grams of all texts are counted in 2^23 cells. A set is ordered from the rarest
   cell to the most frequent, by hash within a cell's level. Any fixed order gives the same links;
   the counts only decide how much work they take.
3. *Prefix.* Two sets that link share an n-gram among the first ``size - ceil(t * size) + 1``
   of both. Only these n-grams are shuffled.
4. *Few, then rest.* Within an n-gram every node first meets one hub and its two neighbours in an
   order that differs from n-gram to n-gram, which is linear in the group. Linked nodes form
   components. Then only nodes of *different* components of an n-gram meet: of a group of near
   copies, however large, hardly any are left.
5. *Filters.* Sizes may differ by t at most; what lies from the first shared n-gram on must be
   enough in both. The suffix filter, taken over whole sets, counts what cannot be shared: in step 4
   by the parities of 256 hash classes, so that a group of near copies that mostly do not link
   leaves few pairs, then by the counts of 64 classes.
6. *Verification.* Each pair that remains is compared once, on the full sets.

Behaviour: null and empty texts, and texts of white space, have size 0 and link with nothing.
Fewer than n words make one n-gram. Repeated rows are kept; rows with equal sets are in one
component. A null doc_id takes part but is never the smallest one (its component is null if no
linked row has an id). Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog.llm import words
from wearlog.llm.cells import bits_from, cell_of, count_cells, levels
from wearlog.llm.components import components
from wearlog.sources.storage import discard, materialised

CELL_BITS = 23
NODE_BITS = 24
CLASSES = 64
#: Hash classes whose parities are kept as bits; a multiple of 64.
PARITIES = 256
#: Nodes of an n-gram that are ordered together.
GROUP = 1000


def distinct_ngrams(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for _, found in words.batches(texts):
        grams, begin = found.ngrams(n)
        for i in range(len(begin) - 1):
            yield np.unique(grams[begin[i] : begin[i + 1]])


def _node(grams: np.ndarray) -> int:
    """Identity of a set: a hash of its sorted members."""
    spread = words.mix(grams)
    parts = np.array([spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(words.mix(spread + np.uint64(words.BASE)))], np.uint64)
    parts = words.mix(parts + np.uint64(len(grams)))
    return int(words.mix(parts[:1] ^ (parts[1:] * np.uint64(words.BASE))).view(np.int64)[0])


def _parities(grams: np.ndarray) -> np.ndarray:
    """Whether each class has an odd number of members, as bits of longs."""
    counts = np.bincount((grams >> np.uint64(32) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def ngram_sets(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, node (equal for equal sets, null for none), prefix, classes, parities."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def hashed(batch: pa.RecordBatch):
        for grams in distinct_ngrams(batch.column(1), n):
            yield "grams", grams

    # 8 MB at any size
    level = docs.sparkSession.sparkContext.broadcast(count_cells(docs, {"grams": CELL_BITS}, hashed, levels)["grams"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, prefixes, classes, parities = [], [], [], [], []
            for grams in distinct_ngrams(batch.column(1), n):
                size = len(grams)
                sizes.append(size)
                nodes.append(_node(grams) if size else None)
                keep = size - (size * percent + 99) // 100 + 1 if size else 0
                order = np.argsort(level.value[cell_of(grams, CELL_BITS)], kind="stable")[:keep]
                prefixes.append(grams[order].view(np.int64))
                classes.append(np.bincount((grams & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES).clip(max=32767).astype(np.int16))
                parities.append(_parities(grams))
            ids = batch.column(0)
            lists = [pa.array(prefixes, pa.list_(pa.int64())), pa.array(classes, pa.list_(pa.int16())), pa.array(parities, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), *lists],
                names=["doc_id", "size", "node", "prefix", "classes", "parities"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(describe, f"doc_id {kind}, size long, node long, prefix array<long>, classes array<short>, parities array<long>")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Smallest intersection of two sets of these sizes that links them."""
    return F.ceil((a + b) * percent / (100 + percent))


def _fits(percent: int) -> Column:
    """Length and positional filter for a pair that shares an n-gram.

    Two sets that link do so at the first n-gram they share, which is in both prefixes: all they
    share lies from it on (``rest``). A pair may fail here at its later n-grams.
    """
    a, b = F.col("size_a"), F.col("size_b")
    long_enough = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    return long_enough & (F.least("rest_a", "rest_b") >= _needed(a, b, percent))


def _alike(percent: int) -> Column:
    """Suffix filter: members of two sets that fall into different classes cannot be shared."""
    differ = F.zip_with("classes_a", "classes_b", lambda x, y: F.abs(x.cast("int") - y.cast("int")))
    apart = F.aggregate(differ, F.lit(0), lambda x, y: x + y)
    a, b = F.col("size_a"), F.col("size_b")
    return (a + b - apart) / 2 >= _needed(a, b, percent)


def _even(percent: int) -> Column:
    """Suffix filter by parities: each class with an odd sum holds a member that is not shared."""
    apart = sum((F.bit_count(F.get("parities_a", F.lit(k)).bitwiseXOR(F.get("parities_b", F.lit(k)))) for k in range(PARITIES // 64)), F.lit(0))
    a, b = F.col("size_a"), F.col("size_b")
    return (a + b - apart) / 2 >= _needed(a, b, percent)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, after the suffix filter."""
    narrow = nodes.select("node", "size", "classes")
    left = narrow.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("classes").alias("classes_a"))
    right = narrow.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("classes").alias("classes_b"))
    pairs = pairs.join(left, "a").join(right, "b").where(_alike(percent)).select("a", "b")
    pairs = materialised(pairs, "pairs")

    # The texts of the nodes in question are read again; a table of 2^24 bits lets most others pass by.
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    bits = count_cells(wanted, {"node": NODE_BITS}, lambda batch: [("node", _spread(batch.column(0)))], bits_from(1))["node"]
    asked = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, packed = [], []
            for grams in distinct_ngrams(batch.column(0), n):
                if len(grams):
                    node = _node(grams)
                    cell = int(cell_of(_spread(np.array([node], np.int64)), NODE_BITS)[0])
                    if asked.value[cell >> 3] >> (7 - (cell & 7)) & 1:
                        found.append(node)
                        packed.append(grams.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(packed, pa.list_(pa.int64()))], names=["node", "grams"])

    # One set per node is enough. A pair is compared row by row, so long texts take no batch's memory.
    chosen = docs.select("text").mapInArrow(sets, "node long, grams array<long>")
    full = materialised(chosen.groupBy("node").agg(F.first("grams").alias("grams")).join(wanted, "node", "left_semi"), "sets")
    sides = [full.select(F.col("node").alias(of), F.col("grams").alias(f"grams_{of}")) for of in "ab"]
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    compared = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", both.alias("both"), (F.size("grams_a") + F.size("grams_b")).alias("all"))
    linked = materialised(compared.where(F.col("both") * 100 >= (F.col("all") - F.col("both")) * percent).select("a", "b"), "links")
    discard(full)
    discard(pairs)
    return linked


def _spread(nodes) -> np.ndarray:
    values = nodes if isinstance(nodes, np.ndarray) else nodes.to_numpy(zero_copy_only=False)
    return words.mix(values.astype(np.int64).view(np.uint64))


def distinct_sets(sets: DataFrame) -> DataFrame:
    """One row for each node of an ``ngram_sets`` table, with its smallest doc_id as ``doc``."""
    return (
        sets.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc"), *(F.first(c).alias(c) for c in ("size", "prefix", "classes", "parities")))
    )


def linked_nodes(nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The component of each node that links."""
    grams = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = grams.join(shared, "gram").select("gram", "node", "size", (F.col("size") - F.col("pos")).alias("rest"), "n")
    met = materialised(met, "met")

    def side(row: str, of: str) -> list[Column]:
        return [F.col(row + c).alias(f"{'' if c == 'node' else c + '_'}{of}") for c in ("node", "size", "rest")]

    hubs = met.groupBy("gram").agg(F.min(F.struct("node", "size", "rest")).alias("hub"))
    hub_pairs = met.join(hubs, "gram").where("node != hub.node").select(*side("", "a"), *side("hub.", "b"))
    # A group is cut into parts of about GROUP nodes, so that no task has to hold a whole one.
    order = W.partitionBy("gram", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / GROUP))).orderBy(F.xxhash64("gram", "node"), "node")
    nexts = [F.lead(F.struct("node", "size", "rest"), k).over(order) for k in (1, 2)]
    beside = met.where("n > 2").select(*side("", "a"), F.array(*nexts).alias("nexts"))
    side_pairs = beside.select("*", F.explode("nexts").alias("next")).where("next is not null")
    side_pairs = side_pairs.select("a", "size_a", "rest_a", *side("next.", "b"))
    few = hub_pairs.union(side_pairs).where(_fits(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    few = materialised(few, "few")
    first = _verified(few, nodes, docs, n, percent)
    found = components(first)

    named = met.join(found.select("node", "component"), "node", "left").select(
        "gram", "node", "size", "rest", F.coalesce("component", "node").alias("component")
    )
    several = named.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("gram")
    mixed = materialised(named.join(several, "gram").join(nodes.select("node", "parities"), "node"), "mixed")
    sides = [mixed.select("gram", *side("", of), *(F.col(c).alias(f"{c}_{of}") for c in ("component", "parities"))) for of in "ab"]
    apart = (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))
    rest = sides[0].join(sides[1], "gram").where(apart & _fits(percent) & _even(percent))
    second = _verified(rest.select("a", "b").distinct().join(few, ["a", "b"], "left_anti"), nodes, docs, n, percent)
    for table in (met, few, mixed):
        discard(table)
    return components(first.union(second))


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles (set size) and component_id (smallest linked doc_id)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = materialised(ngram_sets(docs, n, percent), "ngrams")
    nodes = materialised(distinct_sets(found), "nodes")
    sets = materialised(found.select("doc_id", "size", "node"), "sizes")
    discard(found)
    found = linked_nodes(nodes, docs, n, percent)
    groups = nodes.select("node", "doc").join(found, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    least = groups.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_node = groups.join(least, "component").select("node", "component_id")
    return sets.select("doc_id", "size", "node").join(of_node, "node", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
