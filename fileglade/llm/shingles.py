"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNDO = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the hash of every word (bytes between blanks) of concatenated texts.

    A word's hash comes from differences of one running polynomial, so no word is looked at alone.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    visible = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[rows[:-1]] = True
    starts = visible.copy()
    starts[1:] &= ~visible[:-1] | edge[1:-1]
    ends = visible.copy()
    ends[:-1] &= ~visible[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, len(data)), out=running[1:])
    value = (running[last] - running[first]) * _powers(_UNDO, len(data))[first]
    row = np.searchsorted(rows, first, side="right") - 1
    return row, mix(value + (last - first).astype(np.uint64))


def shingle_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the hash of every shingle; a text of 1 to 4 words is one shingle."""
    row, word = word_hashes(data, rows)
    if not len(word):
        return row, word
    counts = np.bincount(row, minlength=len(rows) - 1)
    left = np.cumsum(counts)[row] - np.arange(len(row))  # words from here to the text's end
    start = left == counts[row]
    size = np.minimum(left, SHINGLE)
    value = word.copy()
    for k in range(1, SHINGLE):
        more = np.flatnonzero(size > k)
        value[more] = mix(value[more] * np.uint64(0xD6E8FEB86659FD93) + word[more + k])
    own = (left >= SHINGLE) | start
    return row[own], value[own]


def counted(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (row, value) in ascending order, and how often each occurs."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))
