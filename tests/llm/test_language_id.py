from __future__ import annotations

import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wearlog.llm import language_id


def brute_subwords(text: str) -> list[tuple[int, bytes]]:
    data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
    out = []
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            run = data[i : i + n]
            if 32 not in run[1:-1] and not (run[0] == 32 and run[-1] == 32):
                out.append((n, run))
    return out


def test_subwords_match_their_definition():
    texts = ["Hello, wörld!", "", "a", "ab cd", "x1y", "  no  ", "é"]
    joined = "".join(t.lower() for t in texts).encode()
    offsets = np.r_[0, np.cumsum([len(t.lower().encode()) for t in texts])]
    found: dict[int, list[int]] = {i: [] for i in range(len(texts))}
    for rows, text in language_id.subwords(np.frombuffer(joined, np.uint8), offsets):
        for r, t in zip(rows.tolist(), text.tolist()):
            found[t].append(r)
    for i, text in enumerate(texts):
        expected = []
        for n, run in brute_subwords(text):
            packed = int.from_bytes(run, "little")
            expected.append(((packed + n - 1) % 2**32 * 2654435761 % 2**32) >> (32 - language_id.ROW_BITS))
        assert sorted(found[i]) == sorted(expected), text


def test_whole_text_scores_match_the_layer():
    texts = ["the house and the dog " * 5, "das haus und der hund " * 5] * 150
    model = language_id.fit(texts, ["en", "de"] * 150)
    best, sure = language_id.score_texts(model, pa.array(["the dog and the house", "der hund und das haus", None]))
    assert [model.languages[k] for k in best[:2]] == ["en", "de"] and (sure[:2] > 0.5).all()
    rows, share = language_id._features("the dog and the house")
    logits = (share @ model.table[rows] + model.bias) / model.temperature
    p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    assert sure[0] == pytest.approx(p.max(), rel=1e-4)


def test_odd_rows(spark):
    docs = cases.odd_docs(spark)
    model = language_id.learn(docs, F.col("doc_id") != 6)
    assert model.languages == ["de", "en", "fr"] or model.languages == ["de", "en"]
    found = language_id.identify(docs, model)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "rejected"]
    for r in found.collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
        assert r.rejected or lettered
    assert language_id.learn(cases.no_docs(spark), F.lit(True)) is None
    assert language_id.identify(cases.no_docs(spark), None).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_long_texts_are_learned_from(spark):
    rows = [(i, "the house and the dog of a man " * 20, "en") for i in range(40)]
    rows += [(100 + i, "das haus und der hund von dem mann " * 800, "de") for i in range(40)]
    rows += [(200 + i, "1 " * 20_000 + "la maison et le chien " + "2 " * 20_000, "fr") for i in range(40)]
    rows += [(300 + i, "12", "xx") for i in range(40)] + [(400, "la casa y el perro " + "3 " * 40_000, "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.col("doc_id") != 0)
    assert model.languages == ["de", "en", "es", "fr"]
    found = language_id.identify(docs, model).where("lang in ('de', 'en')").collect()
    assert len(found) == 80 and all(r.lang_pred == r.lang and not r.rejected for r in found)
    assert language_id.learn(docs.where("lang = 'de'"), F.lit(True)).languages == ["de"]


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_held_out_accuracy(spark):
    from wearlog.llm.queries import op9_language_id

    langs = {r["doc_id"]: r["lang"] for r in cases.table("documents", cases.MIDDLE)}
    found = op9_language_id(spark, cases.MIDDLE).collect()
    assert len(found) == len(langs)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held_out = [r for r in found if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held_out) >= 0.97 * len(held_out)
    assert sum(r.rejected for r in found) <= 0.01 * len(found)
