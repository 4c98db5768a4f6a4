from __future__ import annotations

from collections import Counter

import cases
import pytest

import corpus_pipeline as pipeline
from test_ngram_join import brute as brute_groups
from wearlog.llm import packing

pytest.importorskip("public_tokenizers")


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select(pipeline.COLUMNS).collect()]


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{cases.MIDDLE}/documents.parquet")
    tables = [rows(docs)]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        result = stage(spark, docs, cases.MIDDLE)
        result.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(rows(docs) if k < 4 else docs.collect())
        if k < 4:
            assert docs.columns == pipeline.COLUMNS
    before, spoken, single, masked, mixed, packed = tables

    # Texts with letters in a language of the labels stay.
    assert set(spoken) <= set(before) and len(spoken) >= 0.99 * len(before)

    groups = {doc: (n, component) for doc, n, component in brute_groups([(r[0], r[1]) for r in spoken])}
    assert Counter(single) == Counter(r for r in spoken if groups[r[0]][1] == r[0] or not groups[r[0]][0])

    assert [r[0] for r in sorted(masked)] == [r[0] for r in sorted(single)]
    plain = {r[0]: r for r in single}
    for r in masked:
        assert r[4] == len(r[1]) and r[2:4] == plain[r[0]][2:4]
        assert r[1] == plain[r[0]][1] or "[secret]" in r[1]
    assert sum("[secret]" in r[1] for r in masked) >= 1 and not any('token = "' in r[1] for r in masked)

    sizes, taken = {}, {}
    whole = {r[0]: r for r in masked}
    for r in masked:
        sizes[r[0]] = len(cases.words(r[1]))
    for r in mixed:
        taken[r[0]] = taken.get(r[0], 0) + len(cases.words(r[1]))
        assert r == whole[r[0]] or (r[4] == len(r[1]) and len(cases.words(r[1])) < sizes[r[0]] + 1)
    assert all(n <= 3 * sizes[d] for d, n in taken.items())
    per_source: dict[str, list[int]] = {}
    for d, n in sizes.items():
        per_source.setdefault(whole[d][3], [0, 0])[0] += n
        per_source[whole[d][3]][1] += taken.get(d, 0)
    from test_mixing import brute_targets

    for source, target in brute_targets({s: x[0] for s, x in per_source.items()}).items():
        assert abs(per_source[source][1] - target) <= 6 * 128

    from public_tokenizers import path
    from test_packing import check
    from tokenizers import Tokenizer

    check([(r[0], r[1]) for r in mixed], packed, Tokenizer.from_file(path(pipeline.TOKENIZER)), packing.CAPACITY)


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    found = [
        (None, long, "en", "a", 1),
        (None, long, "en", "a", 1),
        (None, long + " more", "en", "a", 1),
        (5, long + " more", "en", "b", 1),
        (None, other, "en", "a", 1),
        (None, other + " more", "en", "a", 1),
        (7, "x " + other[:60], "en", "a", 1),
        (7, "x " + other[:60], "en", "a", 1),
        (8, long.replace("w", "u"), "en", "a", 1),
        (8, long.replace("w", "u") + " more", "fr", "a", 1),
        (8, other.replace("v", "t"), "en", "a", 1),
        (9, "", "en", "a", 1),
        (9, None, "en", "a", 1),
        (None, " ", "en", "a", 1),
    ]
    docs = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = rows(pipeline.drop_near_duplicates(spark, docs, ""))
    group = lambda text: (text or "").split(" ")[0] if (text or "").strip() else None
    assert Counter(group(r[1]) for r in kept) == {"w0": 1, "v0": 1, "x": 1, "u0": 1, "t0": 1, None: 3}
    assert {r[0] for r in kept if group(r[1]) == "w0"} == {5} and set(kept) <= set(found)
    again = rows(pipeline.drop_near_duplicates(spark, docs.repartition(2), ""))
    assert Counter(again) == Counter(kept)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", cases.odd_docs(spark)), ("none", cases.no_docs(spark))):
        docs.drop("size", "node", "row", "score").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        result = pipeline.run(spark, f"{tmp_path}/{name}")
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(result.columns)
        assert (result.count() > 0) == (name == "odd")
