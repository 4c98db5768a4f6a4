"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius.

Every distinct word of a text votes with the weight ``1 + ln(occurrences)`` on 128 signed bits, for
or against as its hash says; the signs are the fingerprint (32 hex digits). Equal texts have equal
fingerprints. Likeness of two fingerprints: share of equal bits.

``neighbours`` finds all pairs of distinct fingerprints within a radius r by permuted block tables:
the bits are cut into r + 2 blocks, of which two at least agree if no more than r bits differ, so
a table for each two blocks, joined on both, misses none. Copies share one fingerprint and are not
expanded. ``with_near`` counts them for each row.

``with_next`` compares every text with the next one in descending order of ids and with an edited
form whose second half comes from there. Only compressed texts are shuffled, once, cut into ranges
of ids; the top text of each range is also sent to the range above, where it follows the last one.

Behaviour: a null or empty text has no words and the fingerprint 0. Rows with a null id come last in
the order; rows with equal ids are ordered by checksum and length of their texts, and repeated rows
are kept. A single row is its own next one. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog.llm import words

BITS = 128
#: Rows of a range of ids, and the most ranges (they are named in the plan).
RANGE_ROWS = 2000
MOST_RANGES = 50_000
#: Different bits of fingerprints that are near each other.
RADIUS = 3
#: Fingerprints with the same two blocks, from which on they are told apart by two more.
HOT_KEY = 256
SALTS = 16


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Fingerprint of each text as BITS / 8 bytes."""
    out = []
    for _, found in words.batches(texts):
        bits = np.zeros((len(found.first) - 1, BITS), bool)
        for i, (a, b) in enumerate(zip(found.first[:-1], found.first[1:])):
            if b > a:
                term, times = np.unique(found.hashes[a:b], return_counts=True)
                weight = (1 + np.log(times)).astype(np.float32)
                halves = np.stack([term, words.mix(term ^ np.uint64(words.STEPS[4]))], axis=1)
                votes = weight @ np.unpackbits(halves.view(np.uint8), axis=1).astype(np.float32)
                bits[i] = 2 * votes > weight.sum()
        out.append(np.packbits(bits, axis=1))
    return np.concatenate(out) if out else np.zeros((0, BITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def fingerprint_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [x.tobytes().hex() for x in fingerprints(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(describe, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _cut(blocks: int, spread: bool) -> list[tuple[int, int]]:
    """Masks of the bits of each block, as two signed 64-bit numbers: bits in a row, or every so many-th."""
    masks = []
    for k in range(blocks):
        at = range(k, BITS, blocks) if spread else range(BITS * k // blocks, BITS * (k + 1) // blocks)
        whole = sum(1 << (BITS - 1 - p) for p in at).to_bytes(BITS // 8, "big")
        masks.append((int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)))
    return masks


def _tables(cut: list[tuple[int, int]], *seed: Column) -> Column:
    """Array of (table, key): a key for each two blocks, equal where both blocks are."""
    def key(t: int, i: int, j: int) -> Column:
        masked = [F.col(c).bitwiseAND(F.lit(cut[i][k] | cut[j][k]).cast("long")) for k, c in enumerate(("hi", "lo"))]
        return F.struct(F.lit(t).alias("table"), F.xxhash64(*seed, F.lit(t), *masked).alias("key"))

    return F.array(*[key(t, i, j) for t, (i, j) in enumerate(combinations(range(len(cut)), 2))])


def _first_table(cut: list[tuple[int, int]], differ: tuple[Column, Column]) -> Column:
    """The first table in which two fingerprints meet, from the bits in which they differ."""
    equal = [(differ[0].bitwiseAND(F.lit(x).cast("long")) == 0) & (differ[1].bitwiseAND(F.lit(y).cast("long")) == 0) for x, y in cut]
    return F.coalesce(*[F.when(equal[i] & equal[j], F.lit(t)) for t, (i, j) in enumerate(combinations(range(len(cut)), 2))])


def neighbours(marks: DataFrame, radius: int = RADIUS, column: str = "fingerprint") -> DataFrame:
    """All pairs a < b of distinct fingerprints (hex) with at most ``radius`` different bits.

    A pair meets in several tables and counts in the first. Where more than ``HOT_KEY`` fingerprints
    share a table's key, they meet in tables of a second cut instead, over every (r + 2)-th bit.
    """
    near, far = _cut(radius + 2, False), _cut(radius + 2, True)
    part = lambda k: F.conv(F.substring("mark", 8 * k + 1, 8), 16, 10).cast("long")
    half = lambda k: F.shiftleft(part(k), 32).bitwiseOR(part(k + 1))
    distinct = marks.where(F.col(column).isNotNull()).select(F.col(column).alias("mark")).distinct().select(half(0).alias("hi"), half(2).alias("lo"))
    keyed = distinct.select("hi", "lo", F.explode(_tables(near)).alias("x")).select("hi", "lo", "x.table", "x.key")
    hot = keyed.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key", F.lit(True).alias("hot"))
    plain = F.array(F.struct(F.lit(-1).alias("table"), F.col("key").alias("key")))
    sides = (
        keyed.join(hot, "key", "left")
        .select("hi", "lo", "table", F.explode(F.when(F.col("hot"), _tables(far, F.col("key"))).otherwise(plain)).alias("x"))
        .select("hi", "lo", "table", F.col("x.table").alias("second"), "x.key")
    )
    a, b = sides.alias("a"), sides.alias("b")
    differ = tuple(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in ("hi", "lo"))
    distance = F.bit_count(differ[0]) + F.bit_count(differ[1])
    below = (F.col("a.hi") < F.col("b.hi")) | ((F.col("a.hi") == F.col("b.hi")) & (F.col("a.lo") < F.col("b.lo")))
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.table") == F.col("b.table")) & (F.col("a.second") == F.col("b.second"))
    first = (F.col("a.table") == _first_table(near, differ)) & ((F.col("a.second") < 0) | (F.col("a.second") == _first_table(far, differ)))
    text = lambda s: F.lower(F.concat(*[F.lpad(F.hex(f"{s}.{c}"), 16, "0") for c in ("hi", "lo")]))
    found = a.join(b, same & below & (distance <= radius) & first)
    return found.select(F.least(text("a"), text("b")).alias("a"), F.greatest(text("a"), text("b")).alias("b"), distance.alias("distance"))


def with_near(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Add ``n_near`` (long): other fingerprints of the table within the radius. ``rows`` is read twice.

    Copies share a fingerprint, which counts once. Rows of one fingerprint are dealt to ``SALTS`` keys.
    """
    pairs = neighbours(rows, radius)
    n_near = pairs.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_near"))
    n_near = n_near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "edited_sha256"), F.lit(SALTS)).cast("int"))
    return salted.join(n_near, ["fingerprint", "_salt"], "left").select(*rows.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = int(min(MOST_RANGES, max(1, rows.count() // RANGE_ROWS)))
    shares = F.array(*[F.lit((k + 1) / ranges) for k in range(ranges)])
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges)).alias("tops"), F.max("doc_id").alias("top")).first()
    # Largest id of each range; each is an id of the table, so no range is empty.
    tops = np.array(sorted({*(found.tops or []), *([] if found.top is None else [found.top])}), np.int64)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(1)
            marks = [x.tobytes() for x in fingerprints(texts)]
            plain = [(x.as_py() or "") for x in texts]
            raw = [x.encode("utf-8", "surrogatepass") for x in plain]
            packed = [packer.compress(x) for x in raw]
            out = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                at = 0 if key is None else int(np.searchsorted(tops, key))
                row = (key, len(plain[i]), zlib.crc32(raw[i]), marks[i], packed[i])
                out.append((at, False, *row))
                if key is not None and tops[at] == key:
                    out.append(((at + 1) % len(tops), True, *row))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["at", "guard", "doc_id", "n_chars", "crc", "mark", "packed"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(row, next row); a row is (at, guard, doc_id, n_chars, text, mark)."""
        first = last = None
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            at, guard, key, n, mark, packed = (batch.column(i) for i in (0, 1, 2, 3, 5, 6))
            for i in range(batch.num_rows):
                plain = unpacker.decompress(packed[i].as_py()).decode("utf-8", "surrogatepass")
                row = (at[i].as_py(), guard[i].as_py(), key[i].as_py(), n[i].as_py(), plain, mark[i].as_py())
                if last is not None and last[0] != row[0]:
                    yield last, first  # no text came from below: the order starts anew
                    last = None
                if last is not None:
                    yield last, row
                elif not row[1]:
                    first = row
                last = None if row[1] else row
        if last is not None:
            yield last, first

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            edited = [x[4][: x[3] - x[3] // 2] + y[4][: x[3] // 2] for x, y in held]
            raw = [e.encode("utf-8", "surrogatepass") for e in edited]
            new = fingerprints(pa.array(edited, pa.string()))
            own = np.frombuffer(b"".join(x[5] for x, _ in held), np.uint8).reshape(len(held), -1)
            after = np.frombuffer(b"".join(y[5] for _, y in held), np.uint8).reshape(len(held), -1)
            columns = [
                pa.array([x[2] for x, _ in held], pa.int64()),
                pa.array([x[3] for x, _ in held], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                pa.array([m.tobytes().hex() for m in own], pa.string()),
                pa.array([m.tobytes().hex() for m in new], pa.string()),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, after)),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for x, y in pairs(batches):
            held.append((x, y))
            size += x[3]
            if size >= words.SLICE_BYTES or len(held) >= 5000:
                yield flush()
                size = 0
        if held:
            yield flush()

    sent = rows.mapInArrow(describe, "at long, guard boolean, doc_id long, n_chars long, crc long, mark binary, packed binary")
    ordered = sent.repartition("at").sortWithinPartitions("at", "guard", F.col("doc_id").desc_nulls_last(), "crc", "n_chars")
    return ordered.mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
