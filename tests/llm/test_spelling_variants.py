"""Spelling variants against a comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import cases
import pytest

from wearlog.llm import spelling_variants


def single_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=5):
    """(word, form, root, n, n_near, form_n); neighbours by deleting each character."""
    holes: dict[tuple, set] = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            same = holes[w[:i], w[i + 1 :]]
            near[w] |= same - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_plain_version():
    random.seed(0)
    words = {"".join(random.choice("ab") for _ in range(random.randint(3, 6))) for _ in range(60)}
    near = {r[0]: r[4] for r in plain(dict.fromkeys(words, 1))}
    assert near == {w: sum(single_edit(w, x) for x in words) for w in words}


@pytest.mark.parametrize(("letters", "shortest", "longest", "most"), [("ab", 6, 9, 8), ("abcdé", 6, 8, 16), ("ab", 1, 5, 2), ("abÿ", 6, 40, 4)])
def test_random_words(spark, letters, shortest, longest, most):
    random.seed(7)
    counts = {}
    for _ in range(200):
        w = "".join(random.choice(letters) for _ in range(random.randint(shortest, longest)))
        counts[w] = int(5 * random.choice([1, 1, 4, 25, 130, 700]))
        i = random.randrange(len(w))
        counts[w[:i] + random.choice(letters) + w[i + 1 :]] = 5
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling_variants.group_variants(words, most=most)) == plain(counts)


def test_block_of_one_prefix_and_large_tiles(spark):
    """Very many words with a common beginning and a common end, in blocks of more than a tile."""
    counts = {f"prefix{a}{b}suffix": 5 + (ord(a) + ord(b)) % 90 for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxyz"}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    for most in (4, 128, 100_000):
        assert found(spelling_variants.group_variants(words, most=most)) == plain(counts)


def test_chains_of_forms(spark):
    counts = {"aaaaaa" + "b" * k: 5 ** (k + 1) for k in range(9)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r[0]: r[2] for r in found(spelling_variants.group_variants(words))}
    assert set(got.values()) == {"aaaaaabbbbbbbb"}


def test_odd_rows(spark):
    def counted(docs):
        return spelling_variants.count_words(spelling_variants.runs_of_letters(docs, "doc_id").select("word"), 3, 1)

    counts = Counter()
    for _, text, *_ in cases.odd_rows():
        plain_text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        counts.update(w for w in re.findall("[A-Za-zÀ-ÿ]+", plain_text) if len(w) >= 3)
    assert found(spelling_variants.group_variants(counted(cases.odd_docs(spark)))) == plain(counts)
    assert found(spelling_variants.group_variants(counted(cases.no_docs(spark)))) == []


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
@pytest.mark.parametrize("folder", [cases.SMALL, cases.MIDDLE])
def test_whole_table(spark, folder):
    from wearlog.llm.queries import QUERIES

    counts = Counter()
    for row in cases.table("documents", folder):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"] or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{row['doc_id']}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert found(QUERIES["op13_spelling_variants"](spark, folder)) == plain(counts)
