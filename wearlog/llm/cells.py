"""Counts of hashed features in a fixed number of cells.

A feature falls into the cell given by the leading bits of its hash. All features of all rows
are counted; the table has the same size for any input, so it may be broadcast. A cell's count
is at least the count of each of its features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each task sends its counts in this many parts, which are then added separately.
PARTS = 64


def cell_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def count_cells(
    df: DataFrame,
    features: dict[str, int],
    hashes: Callable[[pa.RecordBatch], Iterator[tuple[str, np.ndarray]]],
    finish: Callable[[np.ndarray], np.ndarray],
) -> dict[str, np.ndarray]:
    """Add up features in 2^bits cells each; ``features`` maps a name to its bits.

    ``hashes`` yields (name, 64-bit hashes) for a batch. ``finish`` turns the counts of consecutive
    cells, a multiple of 8, into bytes where they are added: only these come to the driver, a byte or
    a bit a cell.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {name: np.zeros(1 << bits, np.uint32) for name, bits in features.items()}
        for batch in batches:
            for name, found in hashes(batch):
                np.add.at(counts[name], cell_of(found, features[name]), np.uint32(1))
        packer = zstandard.ZstdCompressor(level=1)
        for name, count in counts.items():
            rows = [packer.compress(part.tobytes()) for part in np.split(count, PARTS)]
            yield pa.RecordBatch.from_pydict({"name": [name] * PARTS, "part": list(range(PARTS)), "counts": rows})

    def total(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << features[key[0].as_py()]) // PARTS
        added = np.zeros(size, np.uint32)
        unpacker = zstandard.ZstdDecompressor()
        for batch in parts:
            for x in batch.column("counts"):
                added += np.frombuffer(unpacker.decompress(x.as_py()), np.uint32)
        packed = zstandard.ZstdCompressor(level=1).compress(finish(added).tobytes())
        yield pa.RecordBatch.from_pydict({"name": [key[0].as_py()], "part": [key[1].as_py()], "counts": [packed]})

    schema = "name string, part long, counts binary"
    summed = df.mapInArrow(partial, schema).groupBy("name", "part").applyInArrow(total, schema)
    parts: dict[tuple, np.ndarray] = {}
    unpacker = zstandard.ZstdDecompressor()
    for row in summed.collect():  # PARTS rows a feature
        parts[row.name, row.part] = np.frombuffer(unpacker.decompress(bytes(row.counts)), np.uint8)
    none = {name: finish(np.zeros((1 << bits) // PARTS, np.uint32)) for name, bits in features.items()}
    return {name: np.concatenate([parts.get((name, k), none[name]) for k in range(PARTS)]) for name in features}


def levels(counts: np.ndarray) -> np.ndarray:
    """One byte a cell that never decreases with the count."""
    return np.minimum(np.floor(8 * np.log2(counts + 1.0)), 255).astype(np.uint8)


def bits_from(least: int) -> Callable[[np.ndarray], np.ndarray]:
    """One bit a cell, set where the count is not less."""
    return lambda counts: np.packbits(counts >= least)
