"""Secret scan: fixed patterns, and probabilistic automata inferred from what they find.

*Patterns.* Three kinds of credentials are found by fixed patterns (below) in whole texts.

*Grammar inference.* The values found are labelled examples of their kind. A bounded sample of
distinct values of a kind becomes a prefix tree whose symbols are character classes; states whose
outgoing frequencies agree within the Hoeffding bound are merged, from the root outwards, until no
more agree. The result is a probabilistic automaton that gives any string a likelihood. One more
automaton is inferred from ordinary long words.

*Scoring.* What pattern spans leave of a run of credential characters is a candidate, and so are its
parts: what follows the first separator of a kind, and the pieces between separators, at =, then
within those at /, and so on, unless the whole is a secret already. A candidate has ``MIN_LENGTH`` or
more characters, with a letter and a digit among them. It is a secret of kind ``format`` if some credential automaton finds it as
likely, per character, as its own held-out examples (all but the least likely hundredth) and more
likely than ordinary words by ``MARGIN``. Pattern spans always stay.

The sample has at most ``sample`` values of a kind, those with the smallest hash, of at most
``MAX_FIT`` characters each; all texts take part in picking it, and all are scanned.

Behaviour: a null text is empty. Spans are in code points with exclusive ends. Equal texts get equal
spans; repeated rows are kept. Without examples of a kind there is no automaton for it, and without
any nothing is added to the patterns. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearlog.sources.storage import materialised

#: The kinds in their order, and the patterns that define them.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
WORD = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")

#: Characters that may join a credential to what stands around it, from the outermost to the innermost.
SEPARATORS = "=/.+_-"
#: Pieces between separators; = at the end of a run may be padding and stays with its piece.
PIECES = [re.compile(r"[^=]+(?:=+\Z)?"), *[re.compile(f"[^{re.escape(c)}]+") for c in SEPARATORS[1:]], re.compile("[^=]+")]

SAMPLE = 1000
MIN_LENGTH = 16
MAX_FIT = 128
CONFIDENCE = 0.05
MARGIN = 0.25
#: Bits per character that lengths not among the examples may cost.
SLACK = 0.1
_FLOOR = 1e-4
#: Character classes and how many characters each has.
_CLASS_SIZE = {"d": 10, "h": 6, "l": 20, "U": 26, "+": 6}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    for run in RUN.finditer(text):  # the other two lie within such a run
        part, at = run[0], run.start()
        if "AKIA" in part:
            found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(part) if m.end() - m.start() >= ACCESS_LEAST]
        if len(part) >= HEX_LEAST:
            found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(part)]
    return sorted(found)


def classes(value: str) -> str:
    """The character class of each character."""
    return "".join(
        "d" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "U" if "A" <= c <= "Z" else "+" for c in value
    )


@dataclass
class State:
    n: int = 0
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)
    passed: dict[str, int] = field(default_factory=dict)


class Automaton:
    """Probabilistic automaton over character classes, merged from a prefix tree."""

    def __init__(self, values: list[str], confidence: float = CONFIDENCE):
        self.states = [State()]
        for value in values:
            at = 0
            for symbol in classes(value):
                state = self.states[at]
                state.n += 1
                state.passed[symbol] = state.passed.get(symbol, 0) + 1
                if symbol not in state.next:
                    state.next[symbol] = len(self.states)
                    self.states.append(State())
                at = state.next[symbol]
            self.states[at].n += 1
            self.states[at].ends += 1
        self._bound = math.sqrt(0.5 * math.log(2 / confidence))
        self._merge()
        self.cutoff = -math.inf

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = (self.states[i] for i in todo.pop())
            if not x.n or not y.n:
                continue
            if self._differ(x.ends, x.n, y.ends, y.n):
                return False
            for symbol in x.passed.keys() | y.passed.keys():
                if self._differ(x.passed.get(symbol, 0), x.n, y.passed.get(symbol, 0), y.n):
                    return False
                if symbol in x.next and symbol in y.next:
                    todo.append((x.next[symbol], y.next[symbol]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the state a."""
        todo = [(a, b)]
        while todo:
            x, y = (self.states[i] for i in todo.pop())
            x.n += y.n
            x.ends += y.ends
            for symbol, times in y.passed.items():
                x.passed[symbol] = x.passed.get(symbol, 0) + times
            for symbol, target in y.next.items():
                if symbol in x.next:
                    todo.append((x.next[symbol], target))
                else:
                    x.next[symbol] = target

    def _merge(self) -> None:
        kept, known = [0], {0}
        while True:
            border = [(a, s, t) for a in kept for s, t in sorted(self.states[a].next.items()) if t not in known]
            if not border:
                return
            a, symbol, b = max(border, key=lambda x: self.states[x[2]].n)
            for other in kept:
                if self._compatible(other, b):
                    self.states[a].next[symbol] = other
                    self._fold(other, b)
                    break
            else:
                kept.append(b)
                known.add(b)

    def likelihood(self, value: str) -> float:
        """Mean log2 probability per character, the end included."""
        total, at = 0.0, 0
        for symbol in classes(value):
            state = self.states[at] if at is not None else None
            p = state.passed.get(symbol, 0) / state.n if state and state.n else 0.0
            total += math.log2(max(p, _FLOOR) / _CLASS_SIZE[symbol])
            at = state.next.get(symbol) if state else None
        end = self.states[at] if at is not None else None
        total += math.log2(max(end.ends / end.n if end and end.n else 0.0, _FLOOR))
        return total / (len(value) + 1)


@dataclass
class Formats:
    """Automata of the credential kinds and of ordinary words."""

    kinds: list[Automaton]
    ordinary: Automaton

    def is_secret(self, value: str) -> bool:
        usual = self.ordinary.likelihood(value)
        return any((own := a.likelihood(value)) >= a.cutoff and own - usual >= MARGIN for a in self.kinds)


def infer(examples: dict[str, list[str]]) -> Formats | None:
    """Automata from values by kind (kind ``""``: ordinary words); every fifth sets the cutoff."""
    kinds = []
    for kind in KINDS[:3]:
        values = sorted(examples.get(kind, []), key=lambda v: hashlib.sha256(v.encode()).digest())
        if values:
            held_out = values[::5]
            automaton = Automaton([v for i, v in enumerate(values) if i % 5] or values)
            found = sorted(automaton.likelihood(v) for v in held_out)
            automaton.cutoff = found[len(found) // 100] - SLACK
            kinds.append(automaton)
    return Formats(kinds, Automaton(sorted(examples.get("", [])) or ["a"])) if kinds else None


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Formats | None:
    """Infer the automata from all texts, through a sample of bounded size."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, bytes]] = defaultdict(dict)
        for batch in batches:
            for value in batch.column(0):
                x = value.as_py() or ""
                spans = base_spans(x)
                for start, kind, end in spans:
                    secret = x[start:end] if kind else ASSIGN.match(x, start)[2]
                    held[KINDS[kind]][secret[:MAX_FIT]] = b""
                # Ordinary words: of each text the first one after its middle, whatever its length.
                word = WORD.search(x, len(x) // 2)
                if word and not any(s < word.end() and word.start() < e for s, _, e in spans):
                    held[""][word[0][:MAX_FIT]] = b""
            for kind, values in held.items():
                if len(values) > 4 * sample:
                    held[kind] = dict.fromkeys(_smallest(values, sample), b"")
        rows = [(k, v) for k, values in held.items() for v in _smallest(values, sample)]
        yield pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.string()), "value": pa.array([r[1] for r in rows], pa.string())})

    found = materialised(docs.select(text).mapInArrow(examples, "kind string, value string").distinct(), "examples")
    chosen: dict[str, list[str]] = {}
    for kind in ("", *KINDS[:3]):
        picked = found.where(F.col("kind") == kind).orderBy(F.sha2("value", 256)).limit(sample)
        chosen[kind] = [r.value for r in picked.select("value").collect()]
    return infer(chosen)


def _smallest(values, sample: int) -> list[str]:
    return sorted(values, key=lambda v: hashlib.sha256(v.encode()).hexdigest())[:sample]


def all_spans(text: str, formats: Formats | None) -> list[tuple[int, int, int]]:
    """Pattern spans and, between them, candidates that the automata take for secrets."""
    base = base_spans(text)
    if formats is None:
        return base
    # Stretches that pattern spans cover, without overlaps; runs come in order, so one index follows them.
    covered: list[list[int]] = []
    for start, _, end in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    found, k = list(base), 0
    for run in RUN.finditer(text):
        while k < len(covered) and covered[k][1] <= run.start():
            k += 1
        at = run.start()
        while at < run.end():
            start, end = covered[k] if k < len(covered) and covered[k][0] < run.end() else (run.end(), run.end())
            if at < start:
                found += _parts(text[at:start], at, formats)
            at = max(at, end)
            if end <= run.end() and start < run.end():
                k += 1
    return sorted(found)


def _parts(value: str, start: int, formats: Formats) -> Iterator[tuple[int, int, int]]:
    """Spans of the secrets in what is left of a run."""
    begin = len(value) - len(value.lstrip(SEPARATORS))
    value, start = value[begin:], start + begin
    for separator in ["", *SEPARATORS]:
        at = value.find(separator) + len(separator)
        if (at or not separator) and _is_candidate(value[at:], formats):
            yield from _pieces(value[:at], start, formats, 0)
            yield start + at, 3, start + len(value)
            return
    yield from _pieces(value, start, formats, 0)


def _is_candidate(value: str, formats: Formats) -> bool:
    return len(value) >= MIN_LENGTH and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and formats.is_secret(value)


def _pieces(value: str, start: int, formats: Formats, level: int) -> Iterator[tuple[int, int, int]]:
    """Secrets among the pieces between separators, from this level inwards."""
    if len(value) < MIN_LENGTH or level == len(PIECES):
        return
    for m in PIECES[level].finditer(value):
        if m[0] != value and _is_candidate(m[0], formats):
            yield start + m.start(), 3, start + m.end()
        else:
            yield from _pieces(m[0], start + m.start(), formats, level + 1)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, formats: Formats | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base, spans = [], []
            for value in batch.column(1):
                found = all_spans(value.as_py() or "", shared.value)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in found))
                base.append(hashlib.sha256(_joined([x for x in found if x[1] < 3]).encode()).hexdigest())
                spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in counts[:3]],
                    pa.array(base, pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(counts[3], pa.int64()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(find, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def mask(text: str, formats: Formats | None, mark: str = "[secret]") -> str:
    """The text with every secret replaced; overlapping spans become one mark."""
    out, at, spans = [], 0, all_spans(text, formats)
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, formats: Formats | None, text: str = "text") -> DataFrame:
    """The rows with secrets masked in the text; a null text stays null, other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    place = docs.columns.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = [None if (x := v.as_py()) is None else mask(x, shared.value) for v in batch.column(place)]
            columns = list(batch.columns)
            columns[place] = pa.array(masked, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)
