from __future__ import annotations

import math
import random
import struct
import zlib
from collections import Counter

import cases
import pytest
import xxhash

from wearlog.llm import sharding


def check(rows: list[tuple], found: list, shards: int) -> list[int]:
    expected = Counter((d, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == expected
    slots: dict[int, list[int]] = {s: [] for s in range(shards)}
    weight = [0] * shards
    for r in found:
        slots[r.shard].append(r.slot)
        weight[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    for numbers in slots.values():
        assert sorted(numbers) == list(range(len(numbers)))
    return weight


def plain_tree(rows: list[tuple], shards: int) -> list[tuple]:
    """Sorted (id, shard) of an exact tree, by sorting each node."""
    points = []
    for doc, text in rows:
        data = (text or "").encode()
        of = (len(data), len(data) - len(text or ""), (text or "").count("\n"))
        crc = 0 if text is None else zlib.crc32(data)
        spot = xxhash.xxh64_intdigest(struct.pack("<q", doc), seed=42) % (1 << 20)
        points.append((doc, len(data) + 8, [(v, crc, spot) for v in of]))
    wide = lambda node, d: math.log2(1 + max(p[2][d][0] for p in node)) - math.log2(1 + min(p[2][d][0] for p in node))
    level, out = [(0, shards, points)], []
    while level:
        split = [n for n in level if n[1] > 1]
        out += [(p[0], first) for first, k, node in level if k == 1 for p in node]
        everything = [p for _, _, node in split for p in node]
        span = [max(1e-9, wide(everything, d)) for d in range(3)] if everything else None
        level = []
        for first, k, node in split:
            d = max(range(3), key=lambda d: wide(node, d) / span[d]) if node else 0
            goal, below, left = sum(p[1] for p in node) * (k // 2) / k, 0, []
            for p in sorted(node, key=lambda p: p[2][d]):
                if below + p[1] >= goal:
                    if below + p[1] - goal < goal - below:
                        left.append(p)
                    break
                left.append(p)
                below += p[1]
            ids = {p[0] for p in left}
            level += [(first, k // 2, left), (first + k // 2, k - k // 2, [p for p in node if p[0] not in ids])]
    return sorted(out)


@pytest.mark.parametrize("ranges", [sharding.RANGES, 7])
def test_tree_matches_sorting_of_each_node(spark, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab \n\u00e9\u4e2d") for _ in range(rng.choice([3, 20, 90, 400]))) for _ in range(120)]
    rows = [(i, None if i % 50 == 7 else "" if i % 50 == 8 else "a copy" * 9 if i % 3 == 0 else rng.choice(texts)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sharding.shard(df, 5, tolerance=0).collect()
    assert sorted((r.doc_id, r.shard) for r in found) == plain_tree(rows, 5)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in cases.odd_rows()]
    for shards in (1, 3, 24):
        check(rows, sharding.shard(cases.odd_docs(spark), shards).collect(), shards)
    assert sharding.shard(cases.no_docs(spark)).count() == 0


def test_one_text_for_most_rows(spark):
    rows = [(i, "the same text over and over" if i % 3 else f"text {i} " * (i % 17)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weight = check(rows, sharding.shard(df, 7).collect(), 7)
    assert max(weight) <= 1.1 * min(weight)


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 10)
    docs = spark.read.parquet(f"{cases.MIDDLE}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in cases.table("documents", cases.MIDDLE)]
    found = sharding.shard(docs).collect()
    weight = check(rows, found, 24)
    longest = max(len((t or "").encode()) + 8 for _, t in rows)
    assert max(weight) - min(weight) <= 2 * longest
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in found}
    # Equal texts lie together.
    places: dict[int, set] = {}
    for r in found:
        places.setdefault(r.text_crc32, set()).add(r.shard)
    assert max(map(len, places.values())) == 1
