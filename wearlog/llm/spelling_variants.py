"""Groups of spelling variants: words that differ by one inserted, deleted or replaced character.

1. *Words.* Maximal runs of Latin letters with A-Z in lower case are counted over all texts; rare and
   short ones go. Partial counts come before the shuffle.
2. *Blocks.* A pair with a shorter length of m shares the first t characters, or, if not, the last
   m - t: P + S, its common prefix and suffix, reach the longer length minus one. So a word is dealt to
   blocks (m, first p characters, last s characters), for m its own length and one less. A block with
   more than ``most`` words is cut again at a t in the middle of what is left, in rounds, until at most
   one free character is left. A block then has at most one word for each letter as free character, and
   for each two letters among the longer words, so each block has a size bound and may be one row.
3. *Tiles.* Blocks of like size are stacked as padded matrices of code points, aligned at the first
   and at the last character. Comparing all rows with all others gives P and S of every pair in a tile;
   P + S >= longer length - 1 is one edit. Blocks beyond ``TILE`` words are worked on as pairs of tiles.
   A pair is taken in one block only: where it was cut, the pair's P decides.
4. *Forms.* A word's form is its most frequent near word, if that is ``ratio`` times as frequent.
   Chains of forms end within log(n) steps to the base ``ratio``, and are followed by doubling.

Behaviour: null and empty texts have no words. Every row counts, repeated ones too. Ties between near
words go to the smallest in code-point order. Other columns than the text are not read, unless the
counted words are made by a caller. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog.sources.storage import discard, materialised

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: Larger blocks are cut again.
MOST = 128
#: Rows of a tile, and cells of the tiles that are compared at a time.
TILE = 256
CELLS = 1 << 22

BLOCK = ["m", "p", "s", "below", "head", "tail"]


def runs_of_letters(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """A row for each run of letters in a text, with A-Z in lower case: ``word`` and the columns to keep."""
    plain = F.translate(F.col(text), UPPER, LOWER)
    return docs.select(*keep, F.explode(F.regexp_extract_all(plain, F.lit(f"({LETTERS})"), 1)).alias("word"))


def count_words(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Words of the column ``word`` that are long and frequent enough, with their counts ``n``."""
    long = words.where(F.length("word") >= min_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _cut(t: Column) -> list[Column]:
    """The two blocks of a word whose block is cut at t: equal up to t, or equal in the last m - t."""
    lower, m = F.col("below"), F.col("m")
    head = F.struct(m.alias("m"), t.alias("p"), F.col("s").alias("s"), lower.alias("below"))
    tail = F.struct(m.alias("m"), F.col("p").alias("p"), (m - t).alias("s"), t.alias("below"))
    return [head, tail]


def _dealt(rows: DataFrame, blocks: list[Column]) -> DataFrame:
    """Deal words to blocks; p and s are the lengths of what a block's words share at both ends."""
    each = rows.select("word", "n", F.explode(F.array(*blocks)).alias("b")).select("word", "n", "b.*")
    return each.select(
        "m", "p", "s", "below", F.substring("word", F.lit(1), F.col("p")).alias("head"),
        F.when(F.col("s") > 0, F.expr("right(word, s)")).otherwise("").alias("tail"), "word", "n",
    )


def _blocks(words: DataFrame, most: int) -> Iterator[DataFrame]:
    """Tables of blocks: what the words share, and all of them as one array.

    ``below``: pairs of the block have a common prefix shorter than that.
    """
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"))
    none = sized.select("*", F.lit(0).alias("p"), F.lit(0).alias("s"), (F.col("m") + 2).alias("below"))
    dealt = materialised(_dealt(none, _cut(F.floor(F.col("m") / 2).cast("int"))), "blocks")
    while True:
        sizes = dealt.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("size"))
        free = F.col("m") - F.col("p") - F.col("s")
        large = (F.col("size") > most) & (free > 1)
        kept = sizes.where((F.col("size") > 1) & ~large).select(*BLOCK)
        yield dealt.join(kept, BLOCK).groupBy(*BLOCK).agg(F.collect_list(F.struct("word", "n")).alias("words"))
        left = dealt.join(sizes.where(large).select(*BLOCK), BLOCK)
        middle = (F.col("p") + F.ceil(free / 2)).cast("int")
        again = materialised(_dealt(left, _cut(middle)), "blocks")
        if again.isEmpty():
            discard(again)
            return
        dealt = again


class _Points:
    """Words as two matrices of code points, padded with 0: aligned left, and reversed."""

    def __init__(self, words: list[str]):
        letters = np.array(words, dtype=np.str_)
        wide = letters.dtype.itemsize // 4
        self.size = np.char.str_len(letters).astype(np.int32)
        self.left = letters.view(np.uint32).reshape(len(words), wide)
        back = self.size[:, None] - 1 - np.arange(wide)
        self.right = np.where(back >= 0, np.take_along_axis(self.left, np.maximum(back, 0), 1), 0)


def _tile(points: _Points, rows: np.ndarray, columns: np.ndarray, m: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of single edits between the rows and the columns of stacked tiles; -1 is no word.

    rows, columns: numbers of words, one line per tile; m, below: those of the tile's block.
    """
    same = points.left[rows][:, :, None] == points.left[columns][:, None]
    prefix = np.where(same.all(-1), same.shape[-1], same.argmin(-1))
    same = points.right[rows][:, :, None] == points.right[columns][:, None]
    suffix = np.where(same.all(-1), same.shape[-1], same.argmin(-1))
    a, b = points.size[rows][:, :, None], points.size[columns][:, None]
    longer, shorter = np.maximum(a, b), np.minimum(a, b)
    near = (prefix + suffix >= longer - 1) & (shorter == m[:, None, None]) & (prefix < below[:, None, None])
    near &= (rows >= 0)[:, :, None] & (columns >= 0)[:, None] & (rows[:, :, None] < columns[:, None])
    tile, i, j = np.nonzero(near)
    return rows[tile, i], columns[tile, j]


def _pairs(words: list[str], first: np.ndarray, m: np.ndarray, below: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of all blocks; block k is words[first[k] : first[k + 1]]."""
    sizes = np.diff(first)
    for length in np.unique(m):
        of_length = np.flatnonzero(m == length)
        inside = np.concatenate([np.arange(first[k], first[k + 1]) for k in of_length])
        points = _Points([words[i] for i in inside])
        begin = np.r_[0, np.cumsum(sizes[of_length])]
        scale = np.ceil(np.log2(sizes[of_length])).astype(int)
        for step in np.unique(scale):
            high = min(1 << step, TILE)
            stack = max(1, CELLS // (high * high * points.left.shape[1]))
            chosen = np.flatnonzero(scale == step)
            # Each block has one tile, or as many as it needs; pairs of tiles are compared.
            many = -(-sizes[of_length[chosen]] // high)
            corner = [(c, i, j) for c, n in zip(chosen, many, strict=True) for i in range(n) for j in range(i, n)]
            for at in range(0, len(corner), stack):
                block, i, j = np.array(corner[at : at + stack]).T
                rows = begin[block][:, None] + i[:, None] * high + np.arange(high)
                columns = begin[block][:, None] + j[:, None] * high + np.arange(high)
                rows = np.where(rows < begin[block + 1][:, None], rows, -1)
                columns = np.where(columns < begin[block + 1][:, None], columns, -1)
                a, b = _tile(points, rows, columns, m[of_length[block]], below[of_length[block]])
                yield inside[a], inside[b]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("words")
        first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        word, n = lists.flatten().flatten()
        words, counts = word.to_pylist(), np.asarray(n)
        m, below = np.asarray(batch.column("m")), np.asarray(batch.column("below"))
        for a, b in _pairs(words, first, m, below):
            x, y = np.r_[a, b], np.r_[b, a]
            yield pa.RecordBatch.from_arrays([word.take(pa.array(x)), word.take(pa.array(y)), pa.array(counts[y])], ["word", "other", "n"])


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """All pairs of single edits, both ways: ``word``, ``other`` and the count ``n`` of the other.

    ``words`` has distinct words with counts. Each pair comes once each way.
    """
    out = None
    for blocks in _blocks(words, most):
        found = blocks.select("m", "below", "words").mapInArrow(_near, "word string, other string, n bigint")
        out = found if out is None else out.unionByName(found)
    return out


def group_variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """Form and root of each word: word, form, root, n, n_near, form_n.

    ``words``: a row for each distinct word with its count ``n``.
    """
    words = materialised(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("other").alias("word")))
    near = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("n")
    table = materialised(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    steps = table.where("form is not null").select("word", F.col("form").alias("root"))
    most_often = words.agg(F.max("n")).first()[0] or 1
    longest = math.log(max(most_often, 1), ratio) + 1 if ratio > 1 else math.inf
    reach = 1
    while reach < longest:
        on = steps.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        further = steps.join(on, F.col("root") == F.col("_from"), "left")
        steps = materialised(further.select("word", F.coalesce("_to", "root").alias("root")), "roots")
        reach *= 2
    done = table.join(steps, "word", "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
