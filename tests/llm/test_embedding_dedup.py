from __future__ import annotations

import math
import random

import cases
import numpy as np
import pytest

from wearlog.llm import embedding_dedup as dedup


def brute(rows: list[tuple], similarity: float = 0.98) -> list[tuple]:
    """Rows (id, vector, label) -> (id, links, component, kept)."""
    good = []
    for _, v, label in rows:
        fine = v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, float) / np.abs(np.array(v, float)).max() if fine else None)
        if fine:
            good[-1] /= np.linalg.norm(good[-1])
    n, group = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = good[i], good[j]
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= similarity:
                n[i] += 1
                n[j] += 1
                group[root(i)] = root(j)
    least: dict = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(root(i)), r[0]) if x is not None]
        least[root(i)] = min(ids) if ids else None
    return sorted(((r[0], n[i], least[root(i)], r[0] is not None and r[0] == least[root(i)]) for i, r in enumerate(rows)), key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0, 0.0, 0.0], 1),
        (2, [2.0, 0.1, 0.0, 0.0], 1),
        (2, [2.0, 0.1, 0.0, 0.0], 1),
        (3, [1.0, 0.0, 0.0, 0.0], 2),
        (4, None, 1),
        (5, [], 1),
        (6, [0.0, 0.0, 0.0, 0.0], 1),
        (7, [1.0, None, 0.0, 0.0], 1),
        (8, [float("nan"), 0.0, 0.0, 0.0], 1),
        (9, [float("inf"), 0.0, 0.0, 0.0], 1),
        (10, [1.0, 0.0, 0.0], 1),
        (11, [1.0, 0.05, 0.0], 1),
        (12, [1.0, 0.0, 0.0, 0.0], None),
        (None, [1.0, 0.0, 0.0, 0.0], 1),
        (13, [1e300, 0.0, 0.0, 0.0], 1),
        (14, [-1.0, 0.0, 0.0, 0.0], 1),
        (15, [1e-310, 0.0, 0.0, 0.0], 2),
        (16, [3.0], 1),
        (17, [5.0], 1),
        (18, [-1.0], 1),
    ]
    full = [(*r, 3, 4, 5) for r in rows]
    df = spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, node long, row long, cell long").repartition(3)
    assert found(dedup.near_duplicates(df)) == brute(rows)
    assert found(dedup.near_duplicates(df.where("false"))) == []
    assert found(dedup.near_duplicates(df.where("embedding is null"))) == brute([rows[4]])


def test_multi_sequence_visits_by_increasing_sum():
    rng = random.Random(9)
    a, b = np.array([rng.random() for _ in range(9)]), np.array([rng.random() for _ in range(7)])
    visited = list(dedup.multi_sequence(a, b, 0.9))
    sums = [a[i] + b[j] for i, j in visited]
    assert sums == sorted(sums) and len(set(visited)) == len(visited)
    assert set(visited) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.9}


def test_full_recall_and_cut_cells(spark, monkeypatch):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.12 * rng.normal(size=16)).tolist(), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    expected = brute(rows)
    monkeypatch.setattr(dedup, "BLOCK", 40)
    assert found(dedup.near_duplicates(df, target_recall=1)) == expected
    links = sum(r[1] for r in expected)
    assert sum(r[1] for r in found(dedup.near_duplicates(df, target_recall=0.95))) >= 0.95 * links > 0


def planted_pairs(many: int, size: int, label: int, start: int, rng) -> list[tuple]:
    """Pairs at cosine 0.981, each far from all others."""
    rows = []
    for i in range(many):
        x, way = rng.normal(size=size), rng.normal(size=size)
        x /= np.linalg.norm(x)
        way -= way @ x * x
        y = 0.981 * x + math.sqrt(1 - 0.981**2) * way / np.linalg.norm(way)
        rows += [(start + 2 * i, x.tolist(), label), (start + 2 * i + 1, y.tolist(), label)]
    return rows


def test_links_count_on_both_sides_and_each_length_has_a_grid(spark):
    rng = np.random.default_rng(12)
    rows = planted_pairs(400, 16, 1, 0, rng) + planted_pairs(300, 12, 1, 2000, rng)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in dedup.near_duplicates(df, target_recall=0.8).collect()}
    joined = 0
    for i, _, _ in rows[::2]:
        pair = got[i], got[i + 1]
        assert pair[0].n_links == pair[1].n_links == int(pair[0].component_id == pair[1].component_id)
        joined += pair[0].n_links
    assert 0.75 * 700 < joined < 700
    assert found(dedup.near_duplicates(df, target_recall=1)) == brute(rows)


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in cases.table("embeddings", cases.MIDDLE)]
    assert found(dedup.near_duplicates(spark.read.parquet(f"{cases.MIDDLE}/embeddings.parquet"))) == brute(rows)
