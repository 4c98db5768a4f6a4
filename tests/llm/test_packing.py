from __future__ import annotations

import random
import zlib
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest

from wearlog.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def check(rows: list[tuple], found: list, tokenizer, capacity: int) -> int:
    expected, total = Counter(), 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    filled: dict[int, list] = {}
    for r in found:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(filled) >= -(-total // capacity)
    return len(filled) - -(-total // capacity)


def test_ids_of_words_are_the_ids_of_the_text(tokenizer):
    rng = random.Random(5)
    bits = ["don't", "it's!", "a.b", "(x)", "É", "é,", "…", "…a", "<|endoftext|>", "<|StartOfText|>", " ", "\n", "\t", "\x1c", "\x85", " ", "İx", "ΟΔΟΣ", "12", "3.4", "日本", "é", "'", "''s", "!'s", "A", "b", "🎉", "​", "ß"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    encoder, found = packing.WordEncoder(FILE), []
    for ids, begin in encoder.encode(pa.array(texts)):
        found += [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
    for text, ids in zip(texts, found, strict=True):
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_plan_uses_each_piece_once():
    rng = random.Random(6)
    for capacity in (10, 64, 257):
        for _ in range(40):
            counts = Counter(min(capacity, int(rng.expovariate(rng.choice([0.01, 0.1, 0.3]))) + 1) for _ in range(rng.randint(0, 300)))
            used = Counter()
            for filling, times in packing.plan(counts, capacity):
                assert sum(x * k for x, k in filling.items()) <= capacity
                for x, k in filling.items():
                    used[x] += k * times
            assert used == counts
    assert sum(n for _, n in packing.plan({3: 2, 4: 1, 6: 1, 7: 1, 5: 1}, 10)) == 3


def test_exact_complements():
    count = np.zeros(11, np.int64)
    count[[2, 3, 5]] = 1
    assert packing.complement(5, count) == [5]
    assert packing.complement(7, count) == [5, 2]
    assert packing.complement(10, count) == [5, 3, 2]
    assert packing.complement(4, count) is None and packing.complement(6, count) is None
    assert count.sum() == 3


def test_odd_rows(spark, tokenizer):
    docs = cases.odd_docs(spark)
    rows = [(r[0], r[1]) for r in cases.odd_rows()]
    for capacity in (16, 4096):
        check(rows, packing.pack(docs, FILE, capacity).collect(), tokenizer, capacity)
    assert packing.pack(cases.no_docs(spark), FILE).count() == 0


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{cases.MIDDLE}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in cases.table("documents", cases.MIDDLE)]
    assert check(rows, packing.pack(docs, FILE).collect(), tokenizer, 4096) <= 2
