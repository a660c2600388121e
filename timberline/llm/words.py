"""Words and lines of a block of texts as flat arrays, with 64-bit hashes made without a loop over them."""

from __future__ import annotations

import numpy as np

# Fixed value: bytes that part words, U+0020 and U+0009 to U+000D.
BLANKS = [0x20, *range(0x09, 0x0E)]
IS_BLANK = np.zeros(256, bool)
IS_BLANK[BLANKS] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 20)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]))
        _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(_BASE, -1, 2**64), np.uint64)]))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of any slices of one byte array: a prefix sum of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        _grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many of them precede each text (rows + 1 entries)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~IS_BLANK[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    if len(data):  # a word ends with its text
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[first] |= inside[1:-1][first]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[last] |= inside[1:-1][last]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all \\n-split lines without the break, and how many precede each text; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(per_text)])


def per_text(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, `owner` as spans() and lines() give it."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[owner[1:]] - sums[owner[:-1]]


def windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of n words within a text, and the index of its first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + m]
    keep = np.ones(m + n, bool)
    for k in range(1, n):  # windows that start in a text's last n - 1 words reach beyond it
        at = owner[1:] - k
        keep[at[at >= 0]] = False
    at = np.flatnonzero(keep[:m])
    return mix(total[at]), at
