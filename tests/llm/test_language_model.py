from __future__ import annotations

import math
from collections import Counter

import cases
import pytest
from pyspark.sql import functions as F

from wearlog.llm import language_model as lm

END = "\0end"


def brute(rows: list[tuple], priors: tuple[float, float] = lm.PRIORS) -> list[tuple]:
    """Word by word, from dictionaries. Rows: (id, text, learn)."""
    seq = lambda text: [END, *cases.words(text), END]
    one, two, three = Counter(), Counter(), Counter()
    for _, text, learn in rows:
        if learn:
            s = seq(text)
            one.update(s[1:])
            two.update(zip(s, s[1:]))
            three.update(zip(s, s[1:], s[2:]))
    n, v = sum(one.values()), len(one)
    root = lambda w: (one[w] + 1) / (n + v + 1)

    def p2(u, w):
        return (two[u, w] + priors[0] * root(w)) / (one[u] + priors[0])

    def p3(t, u, w):
        return (three[t, u, w] + priors[1] * p2(u, w)) / (two[t, u] + priors[1])

    out = []
    for doc, text, _ in rows:
        s = seq(text)
        score = math.log10(p2(s[0], s[1])) + sum(math.log10(p3(a, b, c)) for a, b, c in zip(s, s[1:], s[2:]))
        base = sum(math.log10(root(w)) for w in s[1:])
        out.append((doc, len(s) - 1, sum(one[w] > 0 for w in s[1:]), n, base, score))
    total = sum(root(w) for w in one) + 1 / (n + v + 1)
    return out, total, p3, one, two


def compare(found, expected) -> None:
    rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=str)
    for a, b in zip(rows, sorted(expected, key=str), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_small_corpus_and_probabilities_add_up(spark):
    texts = ["a b c a b d", "a b c", "x a b", "a b c a b c a b", "b a", "", None, "new words a b c", "A B C"]
    rows = [(i, t, i % 4 != 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    found = lm.train_and_score(df, F.col("learn"), ~F.col("learn")).collect()
    expected, total, p3, one, two = brute(rows)
    compare(found, expected)
    assert total == pytest.approx(1)
    for t, u in two:
        if u == END:  # the end of a text, no state
            continue
        assert sum(p3(t, u, w) for w in one) + p3(t, u, "unseen") == pytest.approx(1)


@pytest.mark.parametrize("size, keys, priors", [(1, 2, (1000.0, 20.0)), (7, 1 << 22, (1.5, 0.5)), (lm.CHUNK_TOKENS, 3, (4.0, 2.0))])
def test_scores_do_not_depend_on_chunks_and_ranges(spark, monkeypatch, size, keys, priors):
    monkeypatch.setattr(lm, "RANGE_KEYS", keys)
    texts = ["a b c a b d", "a b c", "x a b", "a b c a b c a b", "b a", "d d d x", "new words a b c", "x a b c", "d d"]
    rows = [(i, t, i % 4 != 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    compare(lm.train_and_score(df, F.col("learn"), ~F.col("learn"), priors, size).collect(), brute(rows, priors)[0])


def test_chunks_meet_their_answers_without_moving(spark):
    df = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, learn boolean")
    found = lm.train_and_score(df, F.col("learn"), ~F.col("learn"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_odd_rows(spark):
    docs = cases.odd_docs(spark)
    learn = F.col("doc_id") % 3 != 1
    found = lm.train_and_score(docs, learn, ~learn).collect()
    rows = [(r[0], r[1], r[0] is not None and r[0] % 3 != 1) for r in cases.odd_rows()]
    compare(found, brute(rows)[0])
    assert {r.held_out for r in found if r.doc_id is None} == {None}
    assert lm.train_and_score(cases.no_docs(spark), learn, ~learn).count() == 0
    untaught = lm.train_and_score(docs, F.lit(False), F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in untaught)


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table(spark):
    from wearlog.llm.queries import op4_lm_scoring
    import zlib

    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2) for r in cases.table("documents")]
    found = op4_lm_scoring(spark, cases.SMALL).collect()
    compare(found, brute(rows)[0])
    assert {r.doc_id for r in found if r.held_out} == {r[0] for r in rows if not r[2]}
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)
