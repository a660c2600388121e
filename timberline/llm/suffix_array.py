"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than the one after them.
The leftmost S of each run starts a substring; those substrings are sorted by
inducing, named by their rank, and the string of names is sorted recursively
by doubling.  From the sorted starts, one scan of the buckets upwards places
all L suffixes and one scan downwards all S suffixes.  A scan handles all
suffixes of a bucket that are known at once; only suffixes that repeat the
bucket's own character wait for the next turn, so a bucket takes as many turns
as its character repeats in a row.
"""

from __future__ import annotations

import numpy as np

from .words import Hasher


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes of t; the end counts as smaller than all."""
    n = len(t)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Suffix array from starts of substrings in (nearly) sorted order."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    kind = t[lms]
    order = np.argsort(kind, kind="stable")
    by = lms[order]
    cut = np.searchsorted(kind[order], np.arange(size + 1))

    def put(found: np.ndarray, place: np.ndarray, sign: int) -> None:
        """Appends found to the buckets of its characters, upwards or downwards."""
        char = t[found]
        o = np.argsort(char, kind="stable")
        found, char = found[o], char[o]
        first = np.flatnonzero(np.concatenate([[True], char[1:] != char[:-1]]))
        length = np.diff(np.append(first, len(char)))
        rank = np.arange(len(char)) - np.repeat(first, length)
        sa[place[char] + sign * rank] = found
        place[char[first]] += sign * length

    head = starts.copy()
    last = np.array([n - 1], np.int32)  # the end induces the last suffix, which is L
    put(last, head, 1)
    for c in np.flatnonzero(counts).tolist():
        done = starts[c]
        while done < head[c]:
            front = sa[done : head[c]] - 1
            done = head[c]
            front = front[front >= 0]
            front = front[~small[front]]
            if len(front):
                put(front, head, 1)
        front = by[cut[c] : cut[c + 1]] - 1
        front = front[front >= 0]
        if len(front):
            put(front, head, 1)
    tail = ends - 1
    for c in np.flatnonzero(counts)[::-1].tolist():
        done = ends[c] - 1
        while done > tail[c]:
            front = sa[tail[c] + 1 : done + 1][::-1] - 1
            done = tail[c]
            front = front[front >= 0]
            front = front[small[front]]
            if len(front):
                put(front, tail, -1)
        # S suffixes of this bucket are placed; its L suffixes follow
        large = sa[starts[c] : head[c]][::-1] - 1
        large = large[large >= 0]
        large = large[small[large]]
        if len(large):
            put(large, tail, -1)
    return sa


def _rank_names(names: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of names by their first `most` names, by doubling."""
    rank, reach = names.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-reach] = rank[reach:] + 1 if reach < len(rank) else 0
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(len(rank), np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, reach = new, 2 * reach
        if reach >= most or reach >= len(rank) or rank[order[-1]] == len(rank) - 1:
            return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t (small non-negative integers) in order of their first `depth` characters at least."""
    t = np.ascontiguousarray(t, np.int16)
    small = _types(t)
    lms = np.flatnonzero(small & ~np.concatenate([[True], small[:-1]])).astype(np.int32)
    size = int(t.max()) + 1
    if len(lms) < 2:
        return _induce(t, small, lms, size)
    first = _induce(t, small, lms, size)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    # equal neighbours get one name; a substring reaches to the next start
    end = np.full(len(t), len(t), np.int64)
    end[lms[:-1]] = lms[1:] + 1
    whole = Hasher(t)(ordered.astype(np.int64), end[ordered])
    names = np.empty(len(t), np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(whole[1:] != whole[:-1])])
    reduced = names[lms]
    if reduced.max() + 1 < len(lms):
        ordered = lms[_rank_names(reduced, depth)]
    return _induce(t, small, ordered, size)


def permuted_common_prefixes(hasher: Hasher, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position its common prefix with the suffix before it in sa, at most `most` (positions not in sa: 0); all suffixes in sa have `most` characters."""
    out = np.zeros(len(hasher.sums) - 1, np.int32)
    if len(sa) < 2:
        return out
    at, before = sa[1:].astype(np.int64), sa[:-1].astype(np.int64)
    low, high = np.zeros(len(at), np.int64), np.full(len(at), most)
    whole = hasher(at, at + most) == hasher(before, before + most)
    low[whole] = most
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        mid = (low[open_] + high[open_] + 1) // 2
        same = hasher(at[open_], at[open_] + mid) == hasher(before[open_], before[open_] + mid)
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)
    out[at] = low
    return out
