"""Word n-gram language model as a weighted backoff automaton.

Tokens of a text: its words (A-Z lower-cased), then one end mark. The mark is also the state in
which every text begins.

*States and arcs.* All words, pairs and triples of all training texts are counted, whatever their
number. A state is a word or a pair that occurs in training, besides the root. With c(h) occurrences
of state h and a fixed ``prior`` k for its length, the arc for word w has probability
``(c(hw) + k q) / (c(h) + k)``, where q is w's probability in the state without h's first word. Without
an arc the automaton takes the failure arc to that state, which has weight ``k / (c(h) + k)``. In the
root every word has ``(c + 1) / (N + V + 1)``, so a word never seen has a probability too. All
probabilities of a state add up to 1.

*Counting.* Texts are read once, into chunks of about ``chunk_tokens`` tokens, saved as numbers of the
chunk's words. A chunk sends its distinct n-gram keys (62 bits of a hash, 2 for the length), sorted and as
differences, in one row for each range of keys; a task adds up the counts of a range over all chunks and
answers each chunk with the totals of the keys it sent. So a chunk gets the part of the automaton that its
texts can reach, and nothing else is held anywhere. A range has about ``RANGE_KEYS`` keys, so the number of
ranges grows with the corpus. Chunks lie in buckets, hence only the answers move when the two meet.

*Scoring.* All texts of a chunk are traversed at once, a token at a time from left to right; each carries its
state and adds up the weights of the arcs and failure arcs it takes.

Behaviour: null and empty texts have the end mark as their only token. Rows with a null doc_id are
scored, not learned from, and have a null ``held_out``. Repeated rows are scored and learned from
as often as they occur. Other columns are not read. A text longer than a chunk is a chunk of its own.
Without training rows every token is unknown (N = V = 0, probability 1). An empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog.llm import words
from wearlog.sources.storage import materialised, scratch_path

#: Prior strength of word states and of pair states.
PRIORS = (1000.0, 20.0)
CHUNK_TOKENS = 3 << 19
RANGE_KEYS = 1 << 22
END = np.uint64(0x452821E638D01377)
WORD, PAIR, TRIPLE = (np.uint64(k) for k in (1, 2, 3))
LENGTH_BITS = np.uint64(3)


def join_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of the sequence that continues a context by a word."""
    return words.mix(words.mix(context ^ np.uint64(words.STEPS[2])) * np.uint64(words.BASE) + word)


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte of all of them, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=np.uint64)


def token_keys(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slice by slice: keys of the tokens of consecutive texts, and tokens of each text."""
    for _, found in words.batches(texts):
        count = found.counts() + 1
        token = np.full(int(count.sum()), END, np.uint64)
        is_word = np.ones(len(token), bool)
        is_word[np.cumsum(count) - 1] = False
        token[is_word] = found.hashes
        yield token, count


def as_tape(token: np.ndarray) -> dict[str, bytes]:
    """Tokens as numbers of distinct words, frequent ones first."""
    distinct, at, times = np.unique(token, return_inverse=True, return_counts=True)
    number = np.empty(len(distinct), np.int64)
    number[np.argsort(-times, kind="stable")] = np.arange(len(distinct))
    return {"words": pack_sorted(distinct), "times": pack(times), "tape": pack(number[at])}


@dataclass
class Chunk:
    """Distinct n-gram keys of a chunk's texts, sorted, and for each token those that end with it.

    ``triple`` of a text's first token is that of no training text, for its state is a word's.
    """

    keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        count = np.asarray(row["n_tokens"], np.int64)
        distinct, times = unpack_sorted(row["words"]), unpack(row["times"]).astype(np.int64)
        number = unpack(row["tape"]).astype(np.int32)
        n = len(number)
        # One array for all, filled and sorted in place: this is what most of a task's memory goes to.
        every = np.empty((3, n), np.uint64)
        np.take(distinct[np.argsort(-times, kind="stable")], number, out=every[0])
        del number
        first = np.r_[0, np.cumsum(count)[:-1]].astype(np.int64)
        every[1] = join_keys(np.r_[END, every[0, :-1]], every[0])  # the token before a first one is an end
        every[2] = join_keys(np.r_[END, every[1, :-1]], every[0])
        every &= ~LENGTH_BITS
        every |= np.array([WORD, PAIR, TRIPLE])[:, None]
        every = every.reshape(-1)
        order = np.argsort(every)
        every = every[order]
        new = np.r_[True, every[1:] != every[:-1]]
        keys = every[new]
        del every
        at = np.empty(3 * n, np.int32)
        at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        return cls(keys, at[:n], at[n : 2 * n], at[2 * n :], first, count)

    def counts(self, learn: np.ndarray) -> np.ndarray:
        """Occurrences of the keys in the texts to learn from."""
        taken = np.repeat(learn, self.count)
        total = np.zeros(len(self.keys), np.int64)
        for at in (self.word, self.pair):
            total += np.bincount(at[taken], minlength=len(total))
        taken[self.first] = False
        return total + np.bincount(self.triple[taken], minlength=len(total))


def chunked(rows: DataFrame, chunk_tokens: int) -> DataFrame:
    """Saved table of chunks, in buckets by chunk. Rows: doc_id, held_out, learn, text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        token, count, which = [], [], []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            found = as_tape(np.concatenate(token))
            many = np.concatenate(count).astype(np.int64)
            columns = [pa.concat_arrays([w.column(k) for w in which]) for k in range(3)]
            learned = int(many[np.asarray(columns[2].fill_null(False))].sum())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (*columns, pa.array(many))]
            row = [pa.array([number]), *lists, pa.array([learned]), pa.array([size]), *[pa.array([found[n]], pa.binary()) for n in ("words", "times", "tape")]]
            names = ["chunk", "doc_id", "held_out", "learn", "n_tokens", "n_learned", "n_all", "words", "times", "tape"]
            number, size = number + 1, 0
            for held in (token, count, which):
                held.clear()
            return pa.RecordBatch.from_arrays(row, names=names)

        for batch in batches:
            at = 0
            for found, many in token_keys(batch.column(3)):
                if size and size + len(found) > chunk_tokens:
                    yield flush()
                token.append(found)
                count.append(many)
                which.append(batch.slice(at, len(many)))
                at += len(many)
                size += len(found)
        if size:
            yield flush()

    schema = f"chunk long, doc_id array<{kind}>, held_out array<boolean>, learn array<boolean>, n_tokens array<long>, n_learned long, n_all long, words binary, times binary, tape binary"
    spark = rows.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select("doc_id", "held_out", "learn", "text").mapInArrow(read, schema)
    found.write.format("parquet").bucketBy(buckets, "chunk").option("path", scratch_path(spark, "chunks")).saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are in the scratch folder
    return chunks


def totals(chunks: DataFrame, n_all: int) -> tuple[DataFrame, int]:
    """Saved table (chunk, part, totals) of the counts of the keys that a chunk has in a range, and V."""
    bits = max(1, (3 * n_all // RANGE_KEYS).bit_length())
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                chunk = Chunk.of(row)
                count = chunk.counts(np.asarray(row["learn"], object) == True)  # noqa: E712
                cuts = np.r_[0, np.searchsorted(chunk.keys, edges), len(chunk.keys)]
                parts = [p for p in range(1 << bits) if cuts[p] < cuts[p + 1]]
                blobs = [[f(x[cuts[p] : cuts[p + 1]]) for p in parts] for f, x in ((pack_sorted, chunk.keys), (pack, count))]
                yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int64()), "chunk": pa.array([row["chunk"]] * len(parts), pa.int64()), "keys": blobs[0], "counts": blobs[1]})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        chunk, keys, counts = [], [], []
        for batch in batches:
            chunk += batch.column("chunk").to_pylist()
            keys += [unpack_sorted(x.as_py()) for x in batch.column("keys")]
            counts += [unpack(x.as_py()) for x in batch.column("counts")]
        cuts = np.r_[0, np.cumsum([len(x) for x in keys])]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        keys.clear()
        total = np.zeros(len(distinct), np.uint64)
        for k, count in enumerate(counts):
            total[at[cuts[k] : cuts[k + 1]]] += count  # a chunk's keys are distinct
        v = int(((distinct & LENGTH_BITS == WORD) & (total > 0)).sum())
        for k, number in enumerate(chunk):
            answer = pack(total[at[cuts[k] : cuts[k + 1]]])
            yield pa.RecordBatch.from_pydict({"chunk": [number], "part": [part], "v": [v if k == 0 else 0], "totals": [answer]})

    columns = ["chunk", "learn", "n_tokens", "words", "times", "tape"]
    sent = chunks.select(*columns).mapInArrow(send, "part long, chunk long, keys binary, counts binary")
    answers = materialised(sent.groupBy("part").applyInArrow(add, "chunk long, part long, v long, totals binary"), "totals")
    return answers.drop("v"), answers.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]


def traverse(chunk: Chunk, n: np.ndarray, root: np.ndarray, priors: tuple[float, float]) -> np.ndarray:
    """log10 weight of each text. ``n``: occurrences of the keys; ``root``: each token's probability in the root."""
    at_word, at_pair, at_triple = n[chunk.word], n[chunk.pair], n[chunk.triple]
    at_triple[chunk.first] = 0
    word_state = np.r_[0, at_word[:-1]]
    pair_state = np.r_[0, at_pair[:-1]]
    ends = chunk.first + chunk.count - 1
    word_state[chunk.first] = at_word[ends]  # all texts begin in the state of the end mark
    pair_state[chunk.first] = 0
    one, two = priors
    # Weights of the arcs that leave the root, a word's and a pair's state at a token, and of failure arcs there.
    arcs, failures = np.empty((3, len(root))), np.empty((3, len(root)))
    arcs[0], failures[0] = root, 1
    for k, (of_arc, of_state, prior) in enumerate(((at_pair, word_state, one), (at_triple, pair_state, two)), 1):
        arcs[k] = (of_arc + prior * arcs[k - 1]) / (of_state + prior)
        failures[k] = prior / (of_state + prior)
    del word_state, pair_state, of_state
    np.log10(arcs, out=arcs)
    np.log10(failures, out=failures)
    has_arc = np.stack([np.ones(len(root), bool), at_pair > 0, at_triple > 0])
    leads_to = np.where(at_pair > 0, 2, np.where(at_word > 0, 1, 0)).astype(np.int8)  # length of the state after a token
    last = at_word[ends] > 0
    del at_word, at_pair, at_triple, of_arc
    order = np.argsort(-chunk.count, kind="stable")
    begin, falling = chunk.first[order], -chunk.count[order]
    weight = np.zeros(len(order))
    state = last[order].astype(np.int8)
    for step in range(int(chunk.count.max(initial=0))):
        live = int(np.searchsorted(falling, -step))  # texts of more tokens than that
        at, s = begin[:live] + step, state[:live]
        for _ in range(2):
            fails = ~has_arc[s, at]
            if fails.any():
                weight[:live] += np.where(fails, failures[s, at], 0.0)
                s = s - fails
        weight[:live] += arcs[s, at]
        state[:live] = leads_to[at]
    out = np.empty(len(order))
    out[order] = weight
    return out


def train_and_score(
    docs: DataFrame,
    learn: Column,
    held_out: Column,
    priors: tuple[float, float] = PRIORS,
    chunk_tokens: int = CHUNK_TOKENS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Learn from the rows where ``learn`` is true and score all rows.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), learn.alias("learn"), held_out.alias("held_out"))
    chunks = chunked(rows, chunk_tokens)
    n, n_all = chunks.agg(F.coalesce(F.sum("n_learned"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    answers, v = totals(chunks, n_all)

    def score(held: pa.Table, answer: pa.Table) -> pa.Table:
        row = held.select(["n_tokens", "words", "times", "tape"]).to_pylist()[0]
        chunk = Chunk.of(row)
        parts = sorted(answer.select(["part", "totals"]).to_pylist(), key=lambda r: r["part"])
        total = np.concatenate([unpack(r["totals"]) for r in parts]).astype(np.int64)
        root = (total[chunk.word] + 1) / (n + v + 1)
        text = np.repeat(np.arange(len(chunk.count)), chunk.count)
        known = np.bincount(text[total[chunk.word] > 0], minlength=len(chunk.count)).astype(np.int64)
        columns = [
            *[held[name].combine_chunks().flatten() for name in ("doc_id", "held_out")],
            pa.array(chunk.count),
            pa.array(known),
            pa.array(np.full(len(known), n, np.int64)),
            pa.array(np.bincount(text, np.log10(root), len(known))),
            pa.array(traverse(chunk, total, root, priors)),
        ]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked = chunks.select("chunk", "doc_id", "held_out", "n_tokens", "words", "times", "tape")
    return asked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)
