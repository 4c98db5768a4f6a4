"""Words of whole texts as numpy arrays: spans, hashes and n-gram hashes of a batch of texts.

A word is a longest run of bytes other than space and the control characters 9 to 13 in the
UTF-8 form of a text. A-Z are lower-cased before hashing, nothing else is. A null text has no
words. Hashes are 64-bit numbers that depend on the word alone, so they agree between tasks,
runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Odd numbers for hashing.
BASE = 0x9E3779B97F4A7C15
STEPS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least n of each."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, SLICE_BYTES)
        back = pow(BASE, -1, 1 << 64)
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)], dtype=np.uint64)
        _inverse = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, back, np.uint64)], dtype=np.uint64)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(STEPS[0])
    h ^= h >> np.uint64(27)
    h = h * np.uint64(STEPS[1])
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of several texts: text i has the words first[i] to first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word sequences of each text and where each text's begin.

        A text with fewer than n words, but at least one, has its whole sequence as the only one.
        """
        words = self.counts()
        many = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
        begin = np.r_[0, np.cumsum(many)]
        total = int(begin[-1])
        at = np.arange(total) + np.repeat(self.first[:-1] - begin[:-1], many)
        length = np.repeat(np.minimum(words, n), many)
        out = length.astype(np.uint64) * np.uint64(BASE)
        padded = np.r_[self.hashes, np.zeros(n, np.uint64)]
        short = bool((words[words > 0] < n).any())
        for k in range(n):
            part = mix(padded[at + k] + np.uint64(STEPS[k % len(STEPS)] * (1 + k // len(STEPS)) % (1 << 64)))
            out += np.where(k < length, part, np.uint64(0)) if short else part
            out = out * np.uint64(BASE)
        return mix(out), begin


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive slices of a string array: index of the first text, bytes, offsets in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        end = min(end, len(texts))
        yield at, whole[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def find(data: np.ndarray, offsets: np.ndarray, lower: bool = True, cuts: np.ndarray | None = None) -> Words:
    """Words of the texts that lie between the offsets; ``cuts`` are positions where words end as well."""
    n = len(data)
    if lower:
        data = data + (((data >= 65) & (data <= 90)).view(np.uint8) << np.uint8(5))
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    if cuts is not None:
        border[cuts] = True
    gap = np.r_[True, ~word]
    starts = np.flatnonzero(word & (gap[:-1] | border[:-1]))
    ends = np.flatnonzero(word & (np.r_[~word[1:], True][:n] | border[1:])) + 1
    first = np.searchsorted(starts, offsets)
    powers, inverse = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return Words(data, starts, ends, first, hashes)


def batches(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, Words]]:
    """Words of a string array slice by slice, with the index of the slice's first text."""
    for at, data, offsets in slices(texts):
        yield at, find(data, offsets, lower)
