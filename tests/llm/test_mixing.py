from __future__ import annotations

import heapq
import random

import cases
import pytest

from wearlog.llm import mixing


def brute_targets(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """Excess is reshared by weight again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = total - sum(stopped.values())
        open_ = [s for s in order if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**share, **stopped}
        stopped |= {s: most * sizes[s] for s in over}


def brute_seats(weights: list[float], seats: int, most: list[int]) -> list[int]:
    won = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * won[i] + 1), i))
    return won


def test_apportionment(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for group in range(30):
        n = rng.randint(1, 9)
        weights = [float(rng.choice([0, 1, 1, 2, 3, 5, 8, 100])) + rng.random() * (group % 2) for _ in range(n)]
        seats = rng.randint(0, 60)
        won = brute_seats(weights, seats, [10_000] * n)
        for i, w in enumerate(weights):
            rows.append((group, i, w, seats, 10_000))
            expected[group, i] = won[i]
    df = spark.createDataFrame(rows, "g int, p int, w double, s long, m long")
    found = mixing.sainte_lague(df, ["g"], ["p"], "w", "s", "m").collect()
    assert {(r.g, r.p): r.quota for r in found} == expected


def check(rows: list[tuple], found: list, block: int, shards: int) -> None:
    sizes, per_doc = {}, {}
    for doc, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(cases.words(text))
        per_doc.setdefault(doc, []).append(len(cases.words(text)))
    targets, taken = brute_targets(sizes), {}
    assert sorted(((r.doc_id, r["size"]) for r in found), key=str) == sorted(((d, n) for d, ns in per_doc.items() for n in ns), key=str)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r.whole * r["size"] + sum(b.behind - b.first for b in r.blocks)
        assert all(0 <= b.first < b.behind <= r["size"] for b in r.blocks)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, target in targets.items():
        # A block for rounding, and a short last block for each shard and pass.
        assert abs(taken[s] - target) <= block * (2 + 4 * shards), (s, taken[s], target)


def test_odd_rows(spark):
    docs = cases.odd_docs(spark)
    found = mixing.mix(docs, block=4, shard_words=1000).collect()
    check([(r[0], r[1], r[3]) for r in cases.odd_rows()], found, 4, 13)
    assert mixing.mix(cases.no_docs(spark)).count() == 0
    empty = docs.where("text is null or text = ''")
    assert [r.taken for r in mixing.mix(empty).collect()] == [0, 0]


def test_small_sources_reach_their_targets(spark):
    """However many shards the corpus has; the tolerance is two blocks and half a hundredth."""
    text = " ".join(["w"] * 50)
    rows = [(i, text, "small") for i in range(80)] + [(1000 + i, text, None) for i in range(3)]
    rows += [(10_000 + i, text, "large") for i in range(6000)] + [(20_000 + i, text, "middle") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(df, block=16, shard_words=4096).collect()
    targets = brute_targets({"small": 4000, "large": 300_000, "middle": 15_000, None: 150})
    assert targets["small"] == 12_000 and targets[None] == 450
    for source, target in targets.items():
        taken = sum(r.taken for r in found if r.source == source)
        assert abs(taken - target) <= 2 * 16 + 0.005 * target, (source, taken, target)


def test_sources_of_any_size_reach_their_targets(spark):
    """With production parameters: within a document or a hundredth."""
    sizes = {"a": 1, "b": 50, "c": 129, "d": 130, "e": 300, "f": 5_000, "g": 100_000, "h": 100_000, None: 7}
    rows = [(i, " ".join(["w"] * min(50, n - at)), s) for s, n in sizes.items() for i, at in enumerate(range(0, n, 50))]
    rows = [(k, text, s) for k, (_, text, s) in enumerate(rows)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    targets = brute_targets(sizes)
    assert targets["c"] == 387
    for source, target in targets.items():
        taken = sum(r.taken for r in found if r.source == source)
        assert abs(taken - target) <= max(50, 0.01 * target), (source, taken, target)


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table_and_reruns(spark):
    docs = spark.read.parquet(f"{cases.MIDDLE}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in cases.table("documents", cases.MIDDLE)]
    found = mixing.mix(docs, block=16, shard_words=100_000).collect()
    check(rows, found, 16, 5)
    again = mixing.mix(docs.repartition(7), block=16, shard_words=100_000).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)
