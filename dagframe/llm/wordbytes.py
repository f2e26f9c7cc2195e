"""Words, their hashes and word shingles of Arrow string columns, worked out on the UTF-8 bytes with numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D. All functions take whole texts; a null text has no bytes.
Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Rows are worked on in runs of at most this many bytes of text (one longer text makes a run of its own).
RUN_BYTES = 2 << 20
SHINGLE = 5

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RANDOM = np.random.default_rng(20240607)
_OF_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_SPREAD = _RANDOM.integers(1, 1 << 63, 8, dtype=U64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, RUN_BYTES), base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a string column."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], held


def runs(column: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes, or one row."""
    at, _ = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last
        first = last


class Words:
    """The words of a run of texts: first and one past the last byte, words per text, text of each word, hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.offsets, self.data = text_bytes(column)
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        inside = ~_BLANK[self.data]
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edges = self.offsets[:-1][self.offsets[:-1] < n]
            opens[edges] = inside[edges]
            ends = self.offsets[1:][self.offsets[1:] > 0] - 1
            closes[ends] = inside[ends]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.first = self.first[:-1]

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, U64)
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_OF_BYTE[self.data] * power[:n], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def word_bytes(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and how many each text has; a text of fewer words has one, its whole sequence."""
    h = words.hashes()
    n = words.counts
    made = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    if not len(h):
        return np.zeros(0, U64), made
    total = np.zeros(len(h), U64)
    padded = np.concatenate([h, np.zeros(size, U64)])
    left = np.repeat(words.first + n, n) - np.arange(len(h))  # words from here to the end of the text
    for j in range(size):
        part = padded[j : j + len(h)] * _SPREAD[j]
        total += part if j == 0 else np.where(left > j, part, U64(0))
    whole = np.repeat(n >= size, n)
    keep = np.where(whole, left >= size, np.arange(len(h)) == np.repeat(words.first, n))
    return mixed(total[keep] + np.where(whole, U64(size), left.astype(U64))[keep]), made


def distinct_by_text(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and how many there are."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(counts))
