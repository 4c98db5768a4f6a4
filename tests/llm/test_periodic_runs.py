"""Runs of words against a search over all periods."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import cases
import numpy as np
import pytest

from wearlog.llm import periodic_runs


def plain(words, shortest=12):
    """(start, length, period) of every run."""
    known: dict = {}
    numbers = np.array([known.setdefault(w, len(known)) for w in words])
    found = {}
    for p in range(1, len(words) // 2 + 1):
        same = np.r_[False, numbers[:-p] == numbers[p:], False]
        start, end = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        for i in np.flatnonzero(end - start >= max(p, shortest - p)):
            found.setdefault((int(start[i]), int(end[i]) + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def edited(row):
    words = cases.WORD.findall(row["text"] or "")
    if row["doc_id"] is None or not words:
        return words
    h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
    if h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def test_random_texts():
    random.seed(5)
    for _ in range(300):
        texts = []
        for _ in range(random.randint(0, 6)):
            n, k = random.choice([0, 1, 11, 12, 13, 40, 90, 250]), random.choice([1, 2, 3, 30])
            words = [random.randrange(k) for _ in range(n)]
            for _ in range(random.randint(0, 3)):  # nested repetitions
                if n > 6:
                    a, p = random.randrange(n - 4), random.randint(1, n // 3)
                    words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
            texts.append(words)
        first = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        for shortest in (2, 12):
            got = periodic_runs.find(np.array(sum(texts, []), np.int64), first, shortest)
            want = [(f + s, f + s + n, p) for f, t in zip(first, texts, strict=False) for s, n, p in sorted(plain(t, shortest), key=lambda r: (r[0], r[2]))]
            assert [tuple(r) for r in got.tolist()] == want


def test_extensions_of_a_grammar():
    random.seed(6)
    for k in (1, 2, 4):
        inner = [random.randrange(k) for _ in range(400)]
        sequence = np.array([k, *inner, k + 1])
        grammar = periodic_runs.Grammar(sequence)
        a, b = np.array([(i, j) for i in range(1, 400, 7) for j in range(i + 1, 401, 5)]).T
        ahead, back = grammar.extension(a, b, 1), grammar.extension(a, b, -1)
        for i, j, f, r in zip(a, b, ahead, back, strict=True):
            assert f == next(x for x in range(500) if sequence[i + x] != sequence[j + x])
            assert r == next(x for x in range(500) if sequence[i - 1 - x] != sequence[j - 1 - x])


def test_long_texts():
    began, n = time.time(), 300_000
    assert periodic_runs.find(np.zeros(n, np.int64), np.array([0, n])).tolist() == [[0, n, 1]]
    assert periodic_runs.find(np.arange(n) % 777, np.array([0, n])).tolist() == [[0, n, 777]]
    # A Fibonacci word has very many runs of many periods.
    a, b = [0], [0, 1]
    while len(b) < 5_000:
        a, b = b, b + a
    got = periodic_runs.find(np.array(b), np.array([0, len(b)]))
    assert [(s, e - s, p) for s, e, p in sorted(got.tolist())] == plain(b)
    assert time.time() - began < 60


def test_odd_rows(spark):
    got = periodic_runs.with_runs(cases.odd_docs(spark)).collect()
    want = []
    for i, text, *_ in cases.odd_rows():
        words = cases.WORD.findall(text or "")
        runs = plain(words)
        want.append((i, runs, collapsed(words, runs)))
    assert sorted([(r.doc_id, sorted(tuple(x) for x in r.runs), r.collapsed) for r in got], key=repr) == sorted(want, key=repr)
    assert periodic_runs.with_runs(cases.no_docs(spark)).count() == 0


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table(spark):
    from wearlog.llm.queries import QUERIES

    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, cases.SMALL).select(names).collect()))
    want = []
    for row in cases.table("documents"):
        words = edited(row)
        runs = plain(words)
        s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed(words, runs))]
        want.append((row["doc_id"], len(runs), s, n, p, None if p is None else 1000 * n // p, *sums))
    assert got == sorted(want)
    assert sum(r[1] > 0 for r in got) > 10
