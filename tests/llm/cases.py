"""Tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import os
import re

import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, row long, score double"


def have_tables() -> bool:
    return os.path.isdir(SMALL) and os.path.isdir(MIDDLE)


def odd_rows() -> list[tuple]:
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    texts = [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (2, base, "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n ", "fr", "a"),
        (6, "word", "en", None),
        (7, "Ünïcode ẞ 日本語 🎉 text here", "de", "a"),
        (None, "no id at all here", None, "b"),
        (8, "12 345 !!", "en", "b"),
        (9, ("long " + base + " ") * 800, "en", "a"),
        (10, base.replace("fox", "cat"), None, "c"),
        (11, 'password = "abcdefgh1234" and AKIA1234567890ABCD ' + "0123456789abcdef" * 3, "en", "c"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), 1, 2, 3, 0.5) for i, t, lang, source in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def table(name: str, folder: str = SMALL) -> list[dict]:
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def words(text: str | None) -> list[str]:
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(small)
