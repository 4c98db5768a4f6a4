from __future__ import annotations

import random

import cases
import numpy as np
import pytest

from wearlog.llm.ngram_join import _parities, ngram_join


def brute(rows: list[tuple], n: int = 5, percent: int = 80) -> list[tuple]:
    sets = []
    for _, text in rows:
        w = cases.words(text)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.append(grams)
    group = list(range(len(rows)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    holders: dict[tuple, list[int]] = {}
    for i, grams in enumerate(sets):
        for g in grams:
            holders.setdefault(g, []).append(i)
    tried = set()
    for some in holders.values():
        for k, i in enumerate(some):
            for j in some[:k]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        group[root(i)] = root(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in (least.get(root(i)), doc) if x is not None]
        least[root(i)] = min(ids) if ids else None
    return sorted(((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in cases.odd_rows()]
    assert found(ngram_join(cases.odd_docs(spark))) == brute(rows)
    assert found(ngram_join(cases.no_docs(spark))) == []


def test_chains_near_copies_and_borders(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for family in range(12):
        words = [rng.choice(vocabulary) + str(family % 3) for _ in range(rng.randint(5, 60))]
        for _ in range(12):
            if rng.random() < 0.7:
                words = list(words)
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    # Exactly 80 of 100: 90 shared of 90 + 90 with 80 in common.
    common = [f"c{i}" for i in range(84)]
    rows.append((900, " ".join(common + [f"x{i}" for i in range(10)])))
    rows.append((901, " ".join(common + [f"y{i}" for i in range(10)])))
    rows.append((902, " ".join(common)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(ngram_join(df)) == brute(rows)


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in cases.table("documents", cases.MIDDLE)]
    assert found(ngram_join(spark.read.parquet(f"{cases.MIDDLE}/documents.parquet"))) == brute(rows)


def test_large_group_of_near_copies_that_mostly_do_not_link(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((1, 2, 3, 4))):
            words[at] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(ngram_join(df)) == brute(rows)


def test_parities_never_reject_a_link():
    """The number of odd classes of two sets is at most the number of members they do not share."""
    rng = np.random.default_rng(5)
    for size in (1, 5, 40, 300, 5000):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate([a[: size * 4 // 5], rng.integers(0, 2**63, size // 3).astype(np.uint64)])
        odd = sum(int(x).bit_count() for x in (_parities(a) ^ _parities(b)).view(np.uint64))
        assert odd <= len(np.setxor1d(a, b))
    assert _parities(np.zeros(0, np.uint64)).tolist() == [0] * 4
