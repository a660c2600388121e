"""Byte-level BPE vocabularies and exact pair merging."""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import numpy as np

#: Entries that a worker's cache of merged slices holds before it starts anew.
CACHE_ENTRIES = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letters that .json vocabularies use for bytes: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id; ids are in the order of the merges."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
        return {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(4)
def special_ids(path: str) -> dict[bytes, int]:
    """Strings that the library takes for one token wherever a text holds them, and their ids."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"].encode(): t["id"] for t in json.load(f)["added_tokens"]}


def special_strings(path: str) -> tuple[bytes, ...]:
    return tuple(special_ids(path))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of all adjacent pairs, the leftmost of lowest rank is joined until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n > 48:
        return _merge_long(piece, ranks)
    get, far = ranks.get, 1 << 60
    parts = [piece[k : k + 1] for k in range(n)]
    best = [get(a + b, far) for a, b in zip(parts, parts[1:], strict=False)]
    while best:
        low = min(best)
        if low == far:
            break
        k = best.index(low)
        parts[k] += parts.pop(k + 1)
        del best[k]
        if k < len(best):
            best[k] = get(parts[k] + parts[k + 1], far)
        if k:
            best[k - 1] = get(parts[k - 1] + parts[k], far)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and linked neighbours: n log n for pre-tokens of any length."""
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    alive = bytearray([1]) * n
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, end = heapq.heappop(heap)
        if not alive[k]:
            continue
        mid = after[k]
        if mid >= n or after[mid] != end:
            continue
        alive[mid] = 0
        after[k] = end
        if end < n:
            before[end] = k
            stop = after[end]
            if (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        if k:
            p = before[k]
            if (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
    ids, k = [], 0
    while k < n:
        ids.append(ranks[piece[k : after[k]]])
        k = after[k]
    return ids


class PairTable:
    """All joinable pairs of ids in an open-addressing table, and pair merging of many pieces in lock-step."""

    FAR = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(10, int(len(keys) * 3).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.FAR, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.key[slot[left]] < 0
            at, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.key[at], self.value[at] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, FAR where it can't be joined."""
        keys = a.astype(np.int64) << 32 | b
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.value[slot], self.FAR)
        left = np.flatnonzero((found != keys) & (found != -1) & (keys >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            found = self.key[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.value[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        for low, high in ((0, 6), (6, 10), (10, 16), (16, 32)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(rows):
                self._lock_step([pieces[k] for k in rows.tolist()], rows, high, out)
        for k in np.flatnonzero(lengths > 32).tolist():
            out[k] = np.array(merge(pieces[k], self.ranks), "<u4").tobytes()
        return out

    def _lock_step(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < size[:, None], self.bytes[raw], np.int32(-1))
        ranks = np.full((len(ids), width), self.FAR, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        columns = np.arange(width)
        while len(ids):
            at = ranks.argmin(1)
            each = np.arange(len(ids))
            low = ranks[each, at]
            if (done := low == self.FAR).any():
                for row, n, line in zip(rows[done].tolist(), size[done].tolist(), ids[done].astype("<u4"), strict=True):
                    out[row] = line[:n].tobytes()
                keep = ~done
                ids, ranks, rows, size, at, low = ids[keep], ranks[keep], rows[keep], size[keep], at[keep], low[keep]
                each = np.arange(len(ids))
                if not len(ids):
                    return
            shift = columns > at[:, None]
            ids[:, :-1] = np.where(shift[:, :-1], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, self.FAR
            ids[each, at] = low
            size -= 1
            after = np.minimum(at + 1, width - 1)
            ranks[each, at] = self.rank(low, np.where(at + 1 < width, ids[each, after], np.int32(-1)))
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.rank(ids[has, at[has] - 1], low[has])
