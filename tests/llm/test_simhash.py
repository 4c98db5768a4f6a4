from __future__ import annotations

import hashlib
import random

import cases
import pytest

from wearlog.llm import simhash


def brute(rows: list[tuple]) -> list[tuple]:
    """(id, characters, hash of the edited text) in descending order of ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (doc, text) in enumerate(order):
        x, y = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(x) // 2
        out.append((doc, len(x), hashlib.sha256((x[: len(x) - half] + y[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def found(rows: list) -> list[tuple]:
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str)


def test_odd_rows(spark, monkeypatch):
    rows, seen = [], set()
    for r in cases.odd_rows():
        if r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    for range_rows in (2000, 3, 1):
        monkeypatch.setattr(simhash, "RANGE_ROWS", range_rows)
        result = simhash.with_next(docs).collect()
        assert found(result) == brute([(r[0], r[1]) for r in rows])
        by_id = {r.doc_id: r for r in result}
        assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[3].fingerprint == by_id[4].fingerprint
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in result)
    assert len(simhash.with_next(cases.odd_docs(spark)).collect()) == len(cases.odd_rows())
    assert simhash.with_next(cases.no_docs(spark)).collect() == []
    assert found(simhash.with_next(docs.where("doc_id = 1")).collect()) == brute([(1, rows[0][1])])
    assert len(simhash.with_next(docs.where("doc_id is null")).collect()) == 1


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 70)
    result = simhash.with_next(spark.read.parquet(f"{cases.MIDDLE}/documents.parquet")).collect()
    assert found(result) == brute([(r["doc_id"], r["text"]) for r in cases.table("documents", cases.MIDDLE)])
    plain = {r.doc_id: r.fingerprint for r in simhash.fingerprint_rows(spark.read.parquet(f"{cases.MIDDLE}/documents.parquet")).collect()}
    assert all(plain[r.doc_id] == r.fingerprint for r in result)
    mean = lambda name: sum(r[name] for r in result) / len(result)
    assert mean("near_edited") > mean("near_next") + 0.05


def near(rows: list, radius: int) -> dict[str, int]:
    marks = {r.fingerprint: int(r.fingerprint, 16) for r in rows}
    return {k: sum(0 < (x ^ y).bit_count() <= radius for y in marks.values()) for k, x in marks.items()}


def test_near_fingerprints_of_odd_rows(spark):
    for docs in (cases.odd_docs(spark), cases.no_docs(spark)):
        plain = simhash.with_next(docs).cache()
        result = simhash.with_near(plain, 6).collect()
        assert len(result) == plain.count()
        assert all(r.n_near == near(result, 6)[r.fingerprint] for r in result)


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_query_has_near_fingerprints(spark):
    from wearlog.llm.queries import op7_document_fingerprints

    result = op7_document_fingerprints(spark, cases.SMALL).collect()
    assert {r.doc_id for r in result} == {r["doc_id"] for r in cases.table("documents")}
    expected = near(result, simhash.RADIUS)
    assert all(r.n_near == expected[r.fingerprint] for r in result)


@pytest.mark.parametrize("hot", [256, 3, 0])
def test_neighbours_match_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng = random.Random(8)
    marks = {rng.getrandbits(128) for _ in range(40)}
    for _ in range(400):
        x = rng.choice(sorted(marks))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(128)
        marks.add(x)
    marks.add(0)
    rows = [(f"{m:032x}",) for m in marks] + [(None,), (f"{0:032x}",)]
    df = spark.createDataFrame(rows, "fingerprint string")
    for radius in (0, 1, 3):
        expected = {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= radius}
        pairs = [tuple(r) for r in simhash.neighbours(df, radius).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected
