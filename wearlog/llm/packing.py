"""Best-fit packing of tokenised documents by exact-complement hashing.

1. *Pieces.* Every text becomes the ids of its tokens and an end id; only documents of more than
   ``capacity`` ids are cut, into full pieces and a rest. The tokeniser must not join across white
   space: a Python worker then shows it each distinct word once and keeps the ids over its tasks;
   the ids of a text are those of its words in order.
2. *Plan.* How to fill sequences depends on lengths alone, so it is worked out on the number of
   pieces of each length: at most ``capacity`` numbers, at any size. From the longest length down, a
   sequence's gap is looked up among available single lengths, sums of two and sums of three; if
   one fits exactly, as many sequences as the counts allow are filled alike. Without one, the
   longest length that fits goes in (best fit) and the smaller gap is looked up again.
3. *Places.* The r-th piece of a length takes the r-th place that the plan has for the length. Pieces
   are numbered by task first and by a sum over tasks, so a length that a third of all pieces have
   is not gathered anywhere.

Behaviour: a null or empty text is a document of the end id alone. Each row is packed once, repeated
rows and rows with equal or null ids too; ``row`` tells them apart. Texts of any length are read
whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wearlog.llm import words
from wearlog.sources.storage import materialised

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a Python worker remembers; with more it starts anew.
REMEMBER = 1 << 21
#: Fixed value: a pattern that keeps letters and marks apart.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Token ids of texts through the ids of their words, which are remembered."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        parts = json.loads(self._tokenizer.to_str())
        self._lower = "'Lowercase'" in str(parts.get("normalizer"))  # then A-Z need not be told from a-z
        self._by_kind = LETTERS_APART in self._patterns(parts.get("pre_tokenizer") or {})
        suffix = parts["model"].get("end_of_word_suffix")
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        if suffix and self._by_kind:
            self._ends[[i for token, i in self._tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self._key = np.zeros(0, np.uint64)
        self._row = np.zeros(0, np.int64)
        self._start = np.zeros(1, np.int64)
        self._ids = np.zeros(0, np.uint32)

    @staticmethod
    def _patterns(node: dict) -> list[str]:
        """Patterns that a pre-tokeniser splits by."""
        return [p for x in node.get("pretokenizers", [node]) for p in (x.get("pattern") or {}).values()]

    def _cuts(self, data: np.ndarray) -> np.ndarray | None:
        """Places between an ASCII letter and an ASCII mark, where such a pre-tokeniser always splits.

        Next to an apostrophe it may not.
        """
        if not self._by_kind:
            return None
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        mark = (data > 32) & (data < 127) & ~letter & ~((data >= 48) & (data <= 57)) & (data != 39)
        return np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1

    def _ids_of(self, spelled: list[str]) -> list[list[int]]:
        """Ids of each word. Words of letters alone are shown many at a time and told apart by their end marks."""
        found: list = [None] * len(spelled)
        plain = [i for i, x in enumerate(spelled) if x.isalpha() and x.lower() == x] if self._ends.any() else []
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(spelled[i] for i in some)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                for i, part in zip(some, np.split(ids, ends[:-1])):
                    found[i] = part.tolist()
        rest = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(rest, self._tokenizer.encode_batch_fast([spelled[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def _learn(self, keys: np.ndarray, spelled: list[str]) -> None:
        found = self._ids_of(spelled)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        rows = np.arange(len(self._start) - 1, len(self._start) - 1 + len(keys))
        at = np.searchsorted(self._key, keys)
        self._key, self._row = np.insert(self._key, at, keys), np.insert(self._row, at, rows)
        self._start = np.concatenate([self._start, self._start[-1] + np.cumsum(lengths)])
        self._ids = np.concatenate([self._ids, np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))])

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice: ids of its texts, an end id after each, and where the texts begin."""
        for _, data, offsets in words.slices(texts):
            # The names of special tokens are matched before letters are made small.
            special = b"<|" in data.tobytes()
            found = words.find(data, offsets, self._lower and not special, None if special else self._cuts(data))
            keys, first, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
            if len(self._key) + len(keys) > REMEMBER:
                self._forget()
            at = np.minimum(np.searchsorted(self._key, keys), max(0, len(self._key) - 1))
            new = np.flatnonzero(self._key[at] != keys) if len(self._key) else np.arange(len(keys))
            if len(new):
                raw = found.data.tobytes()
                spelled = [raw[found.starts[i] : found.ends[i]].decode("utf-8", "replace") for i in first[new]]
                self._learn(keys[new], spelled)
            row = self._row[np.searchsorted(self._key, keys)][inverse] if len(keys) else np.zeros(0, np.int64)
            many = self._start[row + 1] - self._start[row]
            done = np.r_[0, np.cumsum(many)]
            taken = np.arange(done[-1]) + np.repeat(self._start[row] - done[:-1], many)
            per_text = done[found.first[1:]] - done[found.first[:-1]] + 1
            begin = np.r_[0, np.cumsum(per_text)]
            out = np.full(begin[-1], END_ID, np.uint32)
            inside = np.ones(begin[-1], bool)
            inside[begin[1:] - 1] = False
            out[inside] = self._ids[taken]
            yield out, begin


@functools.lru_cache(maxsize=1)
def _encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: row, doc_id, piece, start, length, ids_crc32; task and its number in task and length."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder, row = _encoder(tokenizer_file), task << 40
        used = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            ids, i = batch.column(0), 0
            for tokens, begin in encoder.encode(batch.column(1)):
                raw = tokens.astype("<u4", copy=False).tobytes()
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
                    for piece, start in enumerate(range(a, b, capacity)):
                        length = min(capacity, b - start)
                        crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                        for column, x in zip(columns, (i, row, piece, start - a, length, crc, int(used[length]))):
                            column.append(x)
                        used[length] += 1
                    i += 1
                    row += 1
            which, number, piece, start, length, crc, local = columns
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(which, pa.int64())),
                    pa.array(number, pa.int64()),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                    pa.array(np.full(len(which), task, np.int64)),
                    pa.array(local, pa.int64()),
                ],
                names=["doc_id", "row", "piece", "start", "length", "ids_crc32", "task", "local"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long, task long, local long")


def complement(gap: int, count: np.ndarray) -> list[int] | None:
    """One, two or three available lengths, longest first, that fill the gap exactly."""
    free = count > 0
    if gap < len(free) and free[gap]:
        return [gap]
    longest = int(np.flatnonzero(free)[-1]) if free.any() else 0

    def pair(total: int, most: int) -> list[int] | None:
        a = np.arange(min(total - 1, most), (total - 1) // 2, -1)
        good = a[free[a] & free[total - a]] if len(a) else a
        for x in good.tolist():
            if 2 * x != total or count[x] > 1:
                return [x, total - x]
        return None

    if 2 <= gap <= 2 * longest and (found := pair(gap, longest)):
        return found
    if 3 <= gap <= 3 * longest:
        for a in np.flatnonzero(free[: min(gap - 1, longest + 1)])[::-1].tolist():
            if 3 * a < gap:
                return None
            count[a] -= 1  # so that it is not counted on twice
            free[a] = count[a] > 0
            found = pair(gap - a, a) if gap - a <= 2 * a else None
            count[a] += 1
            free[a] = True
            if found:
                return [a, *found]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings (length -> pieces a sequence) and how many sequences have each."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    fillings = []
    for longest in range(capacity, 0, -1):
        while count[longest]:
            filling = {longest: 1}
            count[longest] -= 1
            gap = capacity - longest
            while gap:
                if found := complement(gap, count):
                    gap = 0
                else:
                    fit = np.flatnonzero(count[: gap + 1])
                    if not len(fit):
                        break
                    found = [int(fit[-1])]
                    gap -= found[0]
                for x in found:
                    filling[x] = filling.get(x, 0) + 1
                    count[x] -= 1
            more = min(int(count[x]) // k for x, k in filling.items())
            for x, k in filling.items():
                count[x] -= more * k
            fillings.append((filling, 1 + more))
    return fillings


def places(fillings: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For runs of piece numbers of a length, in order: first sequence, offset, pieces a sequence."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in fillings:
        offset = 0
        for length, k in filling.items():
            rows.append((length, used.get(length, 0), sequence, offset, k))
            used[length] = used.get(length, 0) + k * times
            offset += k * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "number", "sequence", "offset", "many"), table.T))


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, row, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialised(pieces(docs, tokenizer_file, capacity, doc_id, text), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))

    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")).select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    )
    numbered = cut.join(offsets, ["task", "length"]).withColumn("number", F.col("earlier") + F.col("local"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        order = p["length"] << 48 | p["number"]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            run = np.searchsorted(order, length << 48 | number, "right") - 1
            ahead = number - p["number"][run]
            many = p["many"][run]
            sequence, offset = p["sequence"][run] + ahead // many, p["offset"][run] + ahead % many * length
            kept = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    narrow = numbered.select("doc_id", "row", "piece", "start", "length", "ids_crc32", "number")
    return narrow.mapInArrow(place, narrow.drop("number").schema.add("sequence_id", "long").add("offset", "long"))
