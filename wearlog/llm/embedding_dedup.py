"""Near-duplicate vectors within a label by an inverted multi-index.

1. *Vectors.* Equal vectors of a label become one node with its number of copies. Vectors that are
   null, empty or zero, or hold a null or a number that is not finite, are no nodes.
2. *Codebooks.* Each half of the unit vectors has a codebook of its own, fitted by k-means on a
   bounded sample; their product is a grid of cells, and every node lies in one.
3. *Traversal.* For each half, a codeword's distance is the least way from the node to that codeword's
   region. The multi-sequence traversal visits grid cells by increasing sum of the two (squared)
   distances, until the sum passes a bound. The bound is set so that ``target_recall`` of simulated
   neighbours, all exactly as far as the similarity threshold allows, lie in visited cells; with
   ``target_recall=1`` it is the largest possible distance and no neighbour can be missed.
4. *Verification.* Nodes that visit a cell meet the nodes that live in it, as blocks of at most
   ``BLOCK`` by ``BLOCK`` cosines in double precision. A block sends on counts and one link for each
   node and group that it finds, never its pairs.

The codebooks grow with the fourth root of the number of nodes, so cells keep about the same load.

Behaviour: a row with a null label links with nothing. Vectors of different length never link; each
of the eight most common lengths has a grid, other lengths have one cell each. ``n_links`` counts other rows, copies included; a
pair that only one of the two visits finds counts for both. Repeated
rows are kept and link with each other. A null vec_id takes part and is never the smallest. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearlog.llm.components import components
from wearlog.sources.storage import materialised

SAMPLE = 20_000
#: Least number of simulated neighbours.
TRIALS = 5000
#: Most bytes of doubles in the sample, and most vector lengths that get a grid.
SAMPLE_BYTES = 1 << 26
MOST_LENGTHS = 8
BLOCK = 2048
ROUNDS = 12
MOST_WORDS = 1024


@dataclass
class Grid:
    """Codebooks of the two halves, and the bound of the traversal."""

    halves: tuple[np.ndarray, np.ndarray]
    gaps: tuple[np.ndarray, np.ndarray]
    size: int
    bound: float


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ words.T + (words**2).sum(axis=1), 0)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _squares(x, words).argmin(axis=1)
        times = np.bincount(nearest, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, nearest, x)
        words[times > 0] = total[times > 0] / times[times > 0][:, None]
    return np.unique(words, axis=0)


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def region_distances(grid: Grid, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each half: squared least way to each codeword's region, and the nearest codeword."""
    out = []
    for part, words, gap in zip(split(x), grid.halves, grid.gaps):
        d = _squares(part, words)
        best = d.argmin(axis=1)
        way = (d - d[np.arange(len(d)), best][:, None]) / (2 * gap[best])
        way[np.arange(len(d)), best] = 0
        out.append((way**2, best))
    return out


def fit(x: np.ndarray, k: int, similarity: float, target_recall: float, seed: int = 5) -> Grid:
    """Grid for unit vectors."""
    rng = np.random.default_rng(seed)
    halves = tuple(_means(part, k, rng) for part in split(x))
    gaps = tuple(np.sqrt(_squares(w, w)) + np.eye(len(w)) for w in halves)
    grid = Grid(halves, tuple(np.maximum(g, 1e-12) for g in gaps), x.shape[1], 2 - 2 * similarity + 1e-9)
    if target_recall < 1:
        x = np.repeat(x, -(-TRIALS // len(x)), axis=0)
        aside = rng.normal(size=x.shape)
        aside -= (aside * x).sum(axis=1)[:, None] * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
        near = similarity * x + np.sqrt(1 - similarity**2) * aside
        needed = sum(
            way[np.arange(len(x)), home] for (way, _), (_, home) in zip(region_distances(grid, x), region_distances(grid, near))
        )
        grid.bound = min(grid.bound, float(np.quantile(needed, target_recall)))
    return grid


def multi_sequence(a: np.ndarray, b: np.ndarray, bound: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) by increasing a[i] + b[j], while the sum is at most the bound."""
    first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[first].tolist(), b[second].tolist()
    heap = [(a[0] + b[0], 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > bound:
            return
        yield int(first[i]), int(second[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1)[:, None]


def _rows(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """Rows with an own number and the vector as bytes of doubles; null bytes if it cannot link."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            packed = []
            for value, tag in zip(batch.column(1), batch.column(2)):
                x = None
                if value.is_valid and tag.is_valid and len(value) and not value.values.null_count:
                    x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    x = (x + 0.0).tobytes() if np.isfinite(x).all() and x.any() else None
                packed.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), batch.column(2), pa.array(packed, pa.binary())],
                names=["row", "vec_id", "label", "packed"],
            )
            row += batch.num_rows

    chosen = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    return chosen.mapInArrow(clean, f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, packed binary")


def _cells(nodes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """Nodes with the cell in which each lives and the cells that it visits.

    Grids are given by length in bytes; nodes of other lengths live in cell -1 and visit it.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(grids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() for x in batch.column("packed")]
            lengths = np.array([len(x) for x in raw], np.int64)
            own, seen = np.full(len(raw), -1, np.int64), [[-1] for _ in raw]
            for size, g in shared.value.items():
                at = np.flatnonzero(lengths == 8 * size)
                if len(at):
                    (way_a, home_a), (way_b, home_b) = region_distances(g, unit([raw[i] for i in at]))
                    own[at] = home_a.astype(np.int64) * MOST_WORDS + home_b
                    for i, a, b in zip(at, way_a, way_b):
                        seen[i] = [x * MOST_WORDS + y for x, y in multi_sequence(a, b, g.bound)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array(seen, pa.list_(pa.int32()))], names=[*batch.schema.names, "cell", "visited"]
            )

    narrow = nodes.select("node", "label", "copies", "packed").withColumn("length", F.length("packed"))
    fields = [*narrow.schema.fields, T.StructField("cell", T.LongType()), T.StructField("visited", T.ArrayType(T.IntegerType()))]
    return narrow.mapInArrow(run, T.StructType(fields))


def _unanswered(near: np.ndarray, own: np.ndarray, visited: list[np.ndarray]) -> np.ndarray:
    """Of the pairs of a block, those whose inhabitant (column) does not visit the visitor's cell."""
    cells, at = np.unique(own, return_inverse=True)
    back = np.array([np.isin(cells, v) for v in visited], bool).reshape(len(visited), len(cells))
    return near & ~back.T[at]


def _least_reachable(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node that each row and each column reaches within a block; all have a link."""
    if not len(a):
        return a, b
    most = np.iinfo(np.int64).max
    of_b = b
    while True:
        of_a = np.minimum(a, np.where(near, of_b, most).min(axis=1))
        new = np.minimum(of_b, np.where(near, of_a[:, None], most).min(axis=0))
        if (new == of_b).all():
            return of_a, of_b
        a, of_b = of_a, new


def links(nodes: DataFrame, grids: dict[int, Grid], similarity: float) -> tuple[DataFrame, DataFrame]:
    """Per node its number of linked rows, and a sparse set of links with the same components."""
    key = ["label", "length", "cell"]
    home = materialised(_cells(nodes, grids), "home")
    # New names for the columns, as the table meets itself.
    same = [F.col(c).alias(c) for c in ("label", "length", "node", "copies", "packed")]
    visits = home.select(*same, F.col("cell").alias("own"), F.explode("visited").alias("cell"))
    # Cells with many nodes are cut; each part of the visitors meets each part of the inhabitants.
    parts = home.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("homes")).join(
        visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("visitors")), key
    )
    spot = lambda of: F.pmod(F.xxhash64("node"), F.col(of))
    home = home.join(parts, key).withColumn("h", spot("homes")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("visitors") - 1)))
    visits = visits.join(parts, key).withColumn("v", spot("visitors")).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)))
    block = [*key, "h", "v"]

    def compare(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        x, y = unit(left["packed"].to_pylist()), unit(right["packed"].to_pylist())
        near = np.zeros((len(a), len(b)), bool)
        for start in range(0, len(a), 256):
            near[start : start + 256] = x[start : start + 256] @ y.T >= similarity
        near &= a[:, None] != b
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        near = near[np.ix_(rows, columns)]
        # A pair found from one side only counts for both; one found from both sides counts on each visit.
        seen = [right["visited"][int(j)].values.to_numpy(zero_copy_only=False) for j in columns]
        once = _unanswered(near, left["own"].to_numpy()[rows], seen)
        n = [near @ right["copies"].to_numpy()[columns], left["copies"].to_numpy()[rows] @ once]
        ends = _least_reachable(near, a[rows], b[columns])
        return pa.table(
            {
                "node": np.concatenate([a[rows], b[columns]]),
                "other": np.concatenate(ends),
                "n": np.concatenate(n).astype(np.int64),
            }
        )

    found = visits.select(*block, "node", "packed", "copies", "own").groupBy(*block).cogroup(
        home.select(*block, "node", "packed", "copies", "visited").groupBy(*block)
    )
    found = materialised(found.applyInArrow(compare, "node long, other long, n long"), "near")
    return found.groupBy("node").agg(F.sum("n").alias("n")), found.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, similarity: float = 0.98, target_recall: float = 0.999, sample: int = SAMPLE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = materialised(_rows(df, vec_id, vector, label), "vectors")
    nodes = (
        rows.where("packed is not null")
        .groupBy("label", "packed")
        .agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    )
    nodes = materialised(nodes, "nodes")
    if nodes.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    by_length = nodes.groupBy(F.length("packed").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length")
    grids, chosen = {}, by_length.limit(MOST_LENGTHS).collect()
    for length, n in chosen:
        size = max(1, min(sample, SAMPLE_BYTES // length) // len(chosen))
        picked = nodes.where(F.length("packed") == length).orderBy(F.xxhash64("packed"), "node").limit(size).select("packed").collect()
        words = int(min(MOST_WORDS, np.ceil(n**0.25)))
        grids[length // 8] = fit(unit([bytes(r.packed) for r in picked]), words, similarity, target_recall)
    counts, sparse = links(nodes, grids, similarity)
    found = components(sparse)
    known = nodes.join(counts, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("label", "packed", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return rows.join(known, ["label", "packed"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")), F.lit(False)).alias("kept"),
    )
