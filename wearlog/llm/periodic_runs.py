"""Periodic runs of words by recompression.

The words of a slice of texts become one sequence of numbers, with a number of its own at both ends
of each text, so that no match leaves a text. Blocks of equal symbols and then pairs of neighbours
are replaced by new symbols, in turn, until next to nothing is left: a run-length grammar. Which
neighbours form a pair depends on the two symbols alone, so equal stretches of words are replaced
alike but for their ends.

*Extension.* How far two positions agree is answered for many pairs of positions at once. A pair climbs
the levels while its symbols agree, steps over at most one symbol to stand at a border of the next
level, and at the first difference goes down again, with at most one step a level. That is exact and
takes a logarithmic number of steps, in either direction.

*Candidates.* A run of period p has at least g = max(p, shortest - p) positions that agree with the
one p further on, so one of these is a multiple of g. Only such grid positions are tried: n log n in a
text of n words. Those whose words agree are extended to both sides. Candidates are worked on in parts
of fixed size. An interval found for several periods is a run of the smallest.

A text is one row and one task works on it alone; nothing is shuffled.

Behaviour: null and empty texts, and texts of white space, have no runs and an empty collapsed text.
Every row is worked on by itself, whatever its id. Only the columns that are asked for are read. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts are joined into sequences of about this many words; a longer text is one by itself.
SLICE_WORDS = 1 << 17
#: Candidates that are tried at a time.
PART = 1 << 20
SHORTEST = 12

SALT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """A sequence of symbols and how those of the next level divide it.

    Symbol i lies in symbol above[i] of the next level, which covers cut[above[i]] to cut[above[i] + 1].
    """

    symbols: np.ndarray
    above: np.ndarray
    cut: np.ndarray
    blocks: bool


class Grammar:
    """Levels of a sequence; they are made when a question first needs them.

    The first and the last symbol must be unique.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        self.top = symbols.astype(np.int64)
        self.names = int(symbols.max()) + 1
        self.round = 0

    def level(self, k: int) -> Level | None:
        """Level k, or None if the sequence is at its end there."""
        while len(self.levels) <= k and len(self.top) > 3:
            if not self._blocks():
                self._pairs()
        return self.levels[k] if k < len(self.levels) else None

    def _grow(self, first: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        cut = np.flatnonzero(first)
        above = np.cumsum(first) - 1
        self.levels.append(Level(self.top, above.astype(np.int32), np.r_[cut, len(first)].astype(np.int32), blocks))
        self.top = symbols

    def _name(self, symbols: np.ndarray, chosen: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """New symbols where chosen, equal ones for equal keys."""
        distinct, which = np.unique(keys, return_inverse=True)
        symbols = symbols.copy()
        symbols[chosen] = which + self.names
        self.names += len(distinct)
        return symbols

    def _blocks(self) -> bool:
        first = np.r_[True, self.top[1:] != self.top[:-1]]
        if first.all():
            return False
        start = np.flatnonzero(first)
        length = np.diff(np.r_[start, len(first)])
        many = length > 1
        symbols = self.top[start]
        named = self._name(symbols, many, symbols[many] * (int(length.max()) + 1) + length[many])
        self._grow(first, named, True)
        return True

    def _pairs(self) -> None:
        self.round += 1
        mixed = (self.top.astype(np.uint64) + np.uint64(self.round)) * SALT
        mixed = (mixed ^ (mixed >> np.uint64(29))) * SALT
        left = mixed >> np.uint64(63) == 1
        joined = left[:-1] & ~left[1:]
        if not joined.any():
            return
        first = np.r_[True, ~joined]
        start = np.flatnonzero(first)
        pair = np.r_[joined, False][start]
        symbols = self.top[start]
        named = self._name(symbols, pair, symbols[pair] * self.names + self.top[start[pair] + 1])
        self._grow(first, named, False)

    def extension(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many symbols agree from the borders a and b on, ahead (step 1) or back (step -1).

        Border i is in front of symbol i. Borders of a pair must differ.
        """
        side = 0 if step > 0 else -1
        which, x, y, k = np.arange(len(a)), a, b, 0
        stopped: list[tuple] = []

        def room(level: Level, i: np.ndarray) -> np.ndarray:
            """Symbols up to the next border of the level above."""
            return level.cut[level.above[i] + 1] - i if step > 0 else i - level.cut[level.above[i - 1]]

        while len(which):
            level = self.level(k)
            if level is None:  # all symbols are different
                stopped.append((which, x, y))
                break
            same = level.symbols[x + side] == level.symbols[y + side]
            border = (level.above[x] != level.above[x - 1]) & (level.above[y] != level.above[y - 1])
            rx, ry = room(level, x), room(level, y)
            go = np.where(same & ~border, np.minimum(rx, ry), 0)
            x, y = x + step * go, y + step * go
            climb = same & (border | (rx == ry))
            stopped.append((which[~climb], x[~climb], y[~climb]))
            which, x, y = which[climb], level.above[x[climb]], level.above[y[climb]]
            k += 1
        which, x, y = (np.zeros(0, np.int64),) * 3
        for k in range(len(stopped) - 1, -1, -1):
            if len(which):
                level = self.levels[k]
                x, y = level.cut[x], level.cut[y]
                same = level.symbols[x + side] == level.symbols[y + side]
                most = np.minimum(room(level, x), room(level, y)) if level.blocks else 1
                go = np.where(same, most, 0)
                x, y = x + step * go, y + step * go
            which, x, y = (np.concatenate(parts) for parts in zip((which, x, y), stopped[k], strict=True))
        out = np.zeros(len(a), np.int64)
        out[which] = np.abs(x - a[which])
        return out


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) without those of a larger period for the same interval."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)] if len(runs) else np.zeros(0, bool)
    return runs[new]


def find(numbers: np.ndarray, first: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Runs of several texts: rows (start, end, period), by start, then period.

    Text d is numbers[first[d] : first[d + 1]]. A run has at least twice its period and ``shortest`` words.
    """
    texts = len(first) - 1
    # One unique symbol in front of each text and one at the end.
    sequence = np.empty(len(numbers) + texts + 1, np.int64)
    fence = first + np.arange(texts + 1)
    inside = np.ones(len(sequence), bool)
    inside[fence] = False
    sequence[fence] = np.arange(texts + 1)
    sequence[inside] = numbers + texts + 1
    words = np.diff(first)
    periods = np.where(words >= shortest, words // 2, 0)
    text = np.repeat(np.arange(texts), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    grid = np.maximum(p, shortest - p)
    tries = np.maximum((words[text] - 1 - p) // grid + 1, 0)
    ahead = np.r_[0, np.cumsum(tries)]
    grammar, found, at = Grammar(sequence), [], 0
    while at < len(p):
        end = max(at + 1, int(np.searchsorted(ahead, ahead[at] + PART, "right")) - 1)
        each = np.repeat(np.arange(at, end), tries[at:end])
        i = (np.arange(len(each)) + ahead[at] - ahead[each]) * grid[each]
        x = fence[text[each]] + 1 + i
        hit = sequence[x] == sequence[x + p[each]]
        each, x = each[hit], x[hit]
        at = end
        if not len(x):
            continue
        period = p[each]
        ahead_of, behind = grammar.extension(x, x + period, 1), grammar.extension(x, x + period, -1)
        run = ahead_of + behind >= grid[each]
        shift = text[each] + 1
        found.append(_smallest(np.stack([x - behind - shift, x + period + ahead_of - shift, period], 1)[run]))
    runs = _smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _slice(texts: Sequence[str | None], shortest: int) -> tuple[pa.Array, list[str]]:
    """Runs and collapsed texts of some texts."""
    words = [WORD.findall(t or "") for t in texts]
    first = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
    known: dict[str, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for each in words for w in each), np.int64, int(first[-1]))
    runs = find(numbers, first, shortest)
    # Behind the first period of a run, words go.
    depth = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    stays = np.cumsum(depth)[:-1] == 0
    total = np.r_[0, np.cumsum(stays)]
    collapsed = []
    for d, each in enumerate(words):
        a, b = first[d], first[d + 1]
        if total[b] - total[a] < b - a:
            each = [w for w, s in zip(each, stays[a:b].tolist(), strict=True) if s]
        collapsed.append(" ".join(each))
    owner = np.searchsorted(first, runs[:, 0], "right") - 1
    fields = [runs[:, 0] - first[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    spans = pa.StructArray.from_arrays([pa.array(f.astype(np.int64)) for f in fields], ["start", "length", "period"])
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans), collapsed


def with_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """Every row's key, its runs and the text without repetitions.

    ``runs``: array of start (number of the first word), length and period in words, by start, then
    period. ``collapsed``: the words that are in no run, or in the first period of each run they are
    in, joined by single spaces.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            # White space of a byte ends a word, so half the bytes bound the words.
            size = np.r_[0, np.cumsum([0 if t is None else len(t) // 2 + 1 for t in texts.to_pylist()])]
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(size, size[at] + 2 * SLICE_WORDS, "right")) - 1)
                runs, collapsed = _slice(texts[at:end].to_pylist(), shortest)
                yield pa.RecordBatch.from_arrays([batch.column("key")[at:end], runs, pa.array(collapsed, pa.string())], ["key", "runs", "collapsed"])
                at = end

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, schema).withColumnRenamed("key", key)
