"""Quality rules against a plain version."""

from __future__ import annotations

import re
from collections import Counter

import cases
import pytest

from wearlog.llm import quality_rules


def plain(rows, max_docs=10):
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words."""
    def norm(line):
        return re.sub("[0-9]", "0", " ".join(cases.words(line)))

    holders: dict[tuple, set] = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            holders.setdefault((r["source"], norm(line)), set()).add(r["text"])
    out = []
    for r in rows:
        text = r["text"] or ""
        words = cases.WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if cases.WORD.search(x)]
        removed = sum(len(x.split(" ")) for x in map(norm, lines) if len(holders[r["source"], x]) > max_docs)
        n = len(words)
        failed = n < 50 or 100 * len(covered) > 50 * n
        measures = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        out.append((r["doc_id"], *measures, failed, not failed and 100 * removed <= 50 * n, removed))
    return sorted(out, key=repr)


def found(df):
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_removed_words".split()
    return sorted(map(tuple, df.select(names).collect()), key=repr)


def test_odd_rows(spark):
    rows = [dict(zip("doc_id text lang source".split(), r, strict=False)) for r in cases.odd_rows()]
    for limit in (0, 1, 10):
        assert found(quality_rules.judge(cases.odd_docs(spark), max_docs=limit)) == plain(rows, limit)


def test_shared_lines_deplete(spark):
    own = " ".join(f"w{i}" for i in range(60))
    shared = " ".join(f"menu{i}" for i in range(70))
    rows = [(i, f"{own} {i}\n{shared.upper()} {i % 7}", "a") for i in range(12)]
    rows += [(100 + i, f"{own} {i} x{i}\n{shared} 3", "b") for i in range(10)]  # at the limit of its host
    rows += [(200 + i, f"{own}\nonly copies\n{shared} z", None) for i in range(30)]  # one text
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert all(not got[i].kept and got[i].n_removed_words == 71 for i in range(12))
    assert all(got[100 + i].kept and got[100 + i].n_removed_words == 0 for i in range(10))
    assert all(got[200 + i].kept for i in range(30))
    assert not any(r.base_failed for r in got.values())
    texts = {r.doc_id: r.text for r in quality_rules.without_frequent_lines(docs).collect()}
    assert texts[3] == f"{own} 3" and texts[103] == rows[15][1] and texts[210] == rows[-1][1]


def test_removed_lines_leave_the_others(spark):
    rows = [(i, f"\n{i} a\n\nshared line\n \n{i} b\nshared line", "a") for i in range(11)] + [(50, None, "a"), (51, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {r.doc_id: r.text for r in quality_rules.without_frequent_lines(docs, max_docs=10).collect()}
    # Digits count as 0, so "0 a" and "1 a" are one line; "10 a" is another.
    assert texts[10] == "\n10 a\n\n \n10 b" and texts[3] == "\n3 a\n\n \n3 b" and texts[50] is None and texts[51] == ""


def test_empty_table(spark):
    assert quality_rules.judge(cases.no_docs(spark)).count() == 0
    assert quality_rules.without_frequent_lines(cases.no_docs(spark)).count() == 0


def test_plan_is_native(spark):
    plan = quality_rules.judge(cases.odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table(spark):
    from wearlog.llm.queries import QUERIES

    assert found(QUERIES["op11_quality_rules"](spark, cases.SMALL)) == plain(cases.table("documents"))
