from __future__ import annotations

import hashlib
import random
import re

import cases
import pytest

from wearlog.llm import secrets

HEX40 = "0123456789abcdef" * 2 + "01234567"


def brute(text: str | None) -> list[tuple[int, int, int]]:
    """The fixed patterns as they are stated, without short cuts."""
    x, found = text or "", []
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + f"|{letters('api')}_?{letters('key')}"
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 32]
    return sorted(found)


def test_patterns_match_their_definition():
    rng = random.Random(1)
    bits = ["token", "Secret", "API_KEY", "apikey", "passwd", "ſecret", "toKen", "=", ":", " ", '"', "'", "abc", "ABCDEFGH", "AKIA", "1234567890AB", "0123456789abcdef", "ff", "\n", "é", ".", "=", "-", "x" * 9]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == brute(text), text


def test_automata_tell_formats_apart():
    rng = random.Random(2)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    ordinary = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(8, 20))) for _ in range(200)]
    formats = secrets.infer({"hex": values, "": ordinary})
    assert formats.is_secret("".join(rng.choice("0123456789abcdef") for _ in range(24)))
    for plain in ("mail7.example.com", "97.51.17.173.1234567", "antirestinareatina1", "page-12_of.the/book"):
        assert not formats.is_secret(plain)
    text = "key 0a1b2c3d4e5f60718293a4b5 here"
    assert secrets.all_spans(text, formats) == [(4, 3, 28)]
    assert secrets.mask(text, formats) == "key [secret] here"
    assert secrets.infer({}) is None and secrets.all_spans(text, None) == []


def test_credentials_joined_to_other_characters_are_found():
    rng = random.Random(5)
    new = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    ordinary = ["".join(rng.choice("aeinrst/.-") for _ in range(rng.randint(8, 30))) for _ in range(300)]
    formats = secrets.infer({"access": ["AKIA" + new(16) for _ in range(50)] + [new(20) for _ in range(300)], "": ordinary})
    value, other, hexed = new(20), new(20), HEX40
    for around in ("auth={}", "access_key={}", "{}/rest.of.path", "example.org/v1/{}/x", "a=b&sig={}", "see.{}.end", "name-{}", "x_{}=="):
        text = "go " + around.format(value) + " on"
        assert value not in secrets.mask(text, formats), text
        assert any(k == 3 for _, k, _ in secrets.all_spans(text, formats)), text
    for text in (f"{hexed}.{value}", f"{value}.{hexed}", f"AKIA{other[:16]}/{value}", f"{value}/{hexed}.{other}"):
        masked = secrets.mask(text, formats)
        assert value not in masked and hexed not in masked and other not in masked, text
        spans = secrets.all_spans(text, formats)
        assert [x for x in spans if x[1] < 3] == brute(text)
        assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:]))
    for plain in ("www.antirest.org/inter-sate/a1.html", "stein.rest/rat1-trains_in.nest"):
        assert secrets.all_spans(plain, formats) == []
    assert secrets.all_spans("rest=" * 20_000, formats) == []


def test_merging_keeps_likelihoods_apart():
    automaton = secrets.Automaton(["ab1"] * 50 + ["ab2"] * 50)
    assert automaton.likelihood("ab1") == automaton.likelihood("ab2") > automaton.likelihood("a1b")


def test_odd_rows(spark):
    docs = cases.odd_docs(spark)
    formats = secrets.fit(docs)
    found = secrets.scan(docs, formats).collect()
    expected = {}
    for row in cases.odd_rows():
        spans = brute(row[1])
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
        expected.setdefault(row[0], []).append((*counts, hashlib.sha256(joined.encode()).hexdigest()))
    assert len(found) == len(cases.odd_rows())
    for r in found:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in expected[r.doc_id]
    masked = secrets.redact(docs, formats)
    assert masked.columns == docs.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[3] is None and texts[11] == "[secret] and [secret] [secret]" or "[secret]" in texts[11]
    assert secrets.scan(cases.no_docs(spark), secrets.fit(cases.no_docs(spark))).count() == 0


@pytest.mark.skipif(not cases.have_tables(), reason="no driver tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{cases.MIDDLE}/documents.parquet")
    formats = secrets.fit(docs)
    found = {r.doc_id: r for r in secrets.scan(docs, formats).collect()}
    for row in cases.table("documents", cases.MIDDLE):
        spans = brute(row["text"])
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        r = found[row["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        everything = secrets.all_spans(row["text"], formats)
        assert [x for x in everything if x[1] < 3] == spans
        assert r.spans == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in everything)


def test_time_is_linear_in_the_spans_of_a_text(spark):
    """Fifty thousand credentials, glued runs and other formats in one text."""
    import time

    examples = {kind: [f"{k:08x}{'abcdefgh' * 3}"[:24] for k in range(50)] for kind in secrets.KINDS[:3]}
    formats = secrets.infer(examples | {"": ["word", "other", "thing"]})
    text = " ".join(f"token={k:012d}ab/AKIA{k:016d}.x" for k in range(25_000))
    began = time.time()
    spans = secrets.all_spans(text, formats)
    assert time.time() - began < 20 and len([x for x in spans if x[1] < 3]) >= 25_000
