"""Operator 1: token counts by a finite-state tokenizer.

The vocabulary's pair merging is compiled to a deterministic transducer over
bytes.  Its transitions carry how many tokens become certain with a byte, and
each state carries how many more a pre-token that ends there yields.  The
compilation rests on a property of pair merging: a row of tokens is the
encoding of its bytes exactly if each adjacent pair is the encoding of its own
bytes.  So after any prefix the last token is unique, and all that decides the
future is the longest suffix that begins a token, with the last token and the
relative count at each position of that suffix.  That triple is the state;
states and transitions are made when first met, in tables of bounded size.

Pre-token boundaries come from a second transducer whose chunk state maps are
composed by a parallel prefix scan (`pretoken`).  All pre-tokens of a block
then step through the merge transducer in lock-step, one byte at a time.

Defined results: null and empty texts have 0 bytes and 0 tokens; the special
strings of a .json vocabulary count as one token each wherever they stand;
repeated rows give repeated results; null ids of documents pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import merges, pretoken
from .batches import blocks, flat

#: States of a compiled transducer, of 5 bytes for each byte value met. What would need another state is counted by pair merging itself.
MAX_STATES = 150_000
FULL = 1  # the state that stands for all further ones


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.begins = {t[:k] for t in ranks for k in range(len(t) + 1)}
        self.words = {rank: token for token, rank in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.width = 64  # columns of the tables; a byte gets one when first met
        self.column = np.full(256, -1, np.int64)
        self.byte_of: list[int] = []
        self.next = np.full((4096, self.width), -1, np.int32)
        self.emit = np.zeros((4096, self.width), np.int8)
        self.final = np.zeros(4096, np.int32)
        self._state((b"", (-1,), (0,)))
        self._state((b"", (), (0,)))

    def _state(self, key: tuple) -> int:
        if (k := self.number.get(key)) is None:
            if len(self.states) >= self.max_states:
                return FULL
            k = self.number[key] = len(self.states)
            self.states.append(key)
            if k == len(self.final):
                self.next = np.concatenate([self.next, np.full((k // 2, self.width), -1, np.int32)])
                self.emit = np.concatenate([self.emit, np.zeros((k // 2, self.width), np.int8)])
                self.final = np.concatenate([self.final, np.zeros(k // 2, np.int32)])
            self.final[k] = key[2][-1]
        return k

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b can follow token a (-1: stand first)."""
        if (ok := self.fits.get((a, b))) is None:
            word = self.words[b] if a < 0 else self.words[a] + self.words[b]
            found = merges.merge(word, self.ranks) if a >= 0 else [b]
            ok = self.fits[a, b] = found == ([b] if a < 0 else [a, b])
        return ok

    def columns(self, data: np.ndarray) -> np.ndarray:
        """Column of each byte of data."""
        for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[byte] < 0:
                if len(self.byte_of) == self.width:
                    self.next = np.hstack([self.next, np.full_like(self.next, -1)])
                    self.emit = np.hstack([self.emit, np.zeros_like(self.emit)])
                    self.width *= 2
                self.column[byte] = len(self.byte_of)
                self.byte_of.append(byte)
        return self.column[data]

    def compile(self, state: int, column: int) -> int:
        """Adds the transition and returns the state it leads to."""
        byte = self.byte_of[column]
        if state == FULL:
            self.next[FULL, column] = FULL
            return FULL
        window, last, counts = self.states[state]
        depth, longer = len(window), window + bytes((byte,))
        while longer not in self.begins:
            longer = longer[1:]
        for k in range(len(longer)):
            token = self.ranks.get(longer[k:])
            if token is not None and self._fit(last[at := depth + 1 - (len(longer) - k)], token):
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        keep = depth + 1 - len(longer)
        tokens, counts = [*last[keep:], token], [*counts[keep:], counts[at] + 1]
        base = counts[0]
        for k in range(1, len(longer)):
            if longer[k:] not in self.begins:  # no token can start here any more
                tokens[k], counts[k] = -2, base
        to = self._state((longer, tuple(tokens), tuple(c - base for c in counts)))
        self.next[state, column], self.emit[state, column] = to, base
        return to

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each slice of data."""
        lengths = ends - starts
        short = np.flatnonzero(lengths <= 8)
        if len(short) < 1000:
            return self._walk(data, starts, lengths)
        # equal short slices step once: eight bytes are one machine word
        at = starts[short]
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").ravel()
        words &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - lengths[short])).astype(np.uint64)
        # a zero byte at a slice's end would vanish in the padding, so those slices stay apart by their length
        odd = padded[at + lengths[short] - 1] == 0
        words[odd], short_odd = words[~odd][0] if (~odd).any() else 0, short[odd]
        _, first, back = np.unique(words, return_index=True, return_inverse=True)
        rest = np.concatenate([np.flatnonzero(lengths > 8), short_odd])
        some = np.concatenate([short[first], rest])
        counts = self._walk(data, starts[some], lengths[some])
        out = np.empty(len(lengths), np.int64)
        out[short] = counts[: len(first)][back]
        out[rest] = counts[len(first) :]
        return out

    def _walk(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """All slices step together, the longest first, so that those still active are a prefix."""
        raw, data = data, self.columns(data)
        order = np.argsort(-lengths, kind="stable")
        at, total = starts[order], np.zeros(len(order), np.int64)
        state = np.zeros(len(order), np.int64)
        left = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), "right")
        k = 0
        for k, n in enumerate([*left.tolist(), 0]):  # noqa: B007
            if n <= 16:
                break
            cell = state[:n] * self.width + data[at[:n] + k]
            to = self.next.ravel()[cell]
            if (miss := to < 0).any():
                for c in np.unique(cell[miss]).tolist():
                    self.compile(c // self.width, c % self.width)
                to = self.next.ravel()[cell]
            total[:n] += self.emit.ravel()[cell]
            state[:n] = to
        for j in range(n):  # a few long slices go one after the other
            s, more = int(state[j]), 0
            for column in data[at[j] + k : at[j] + lengths[order[j]]].tolist():
                to = int(self.next[s, column])
                if to < 0:
                    to = self.compile(s, column)
                more += int(self.emit[s, column])
                s = to
            state[j], total[j] = s, total[j] + more
        total += self.final[state]
        for j in np.flatnonzero(state == FULL).tolist():
            total[j] = len(merges.merge(raw[at[j] : at[j] + lengths[order[j]]].tobytes(), self.ranks))
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


class Counter:
    """Token counts of whole texts under one vocabulary file."""

    def __init__(self, path: str):
        self.machine = Transducer(merges.load_ranks(path))
        self.special = merges.special_strings(path)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        extra = np.zeros(len(offsets) - 1, np.int64)
        owners = np.arange(len(offsets) - 1)
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            data, offsets, owners = self._without_special(raw, offsets, extra)
        starts, owner = pretoken.split(data, offsets)
        if len(starts) == 0:
            return extra
        each = self.machine.count(data, starts, np.append(starts[1:], len(data)))
        sums = np.concatenate([[0], np.cumsum(each)])
        np.add.at(extra, owners, sums[owner[1:]] - sums[owner[:-1]])
        return extra

    def _without_special(self, raw: bytes, offsets: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cuts texts at special strings, which count in `extra`; the parts between are texts of their own."""
        parts, owners = [], []
        for row, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
            pieces = [raw[a:b]]
            for s in self.special:
                pieces = [q for p in pieces for q in p.split(s)]
            extra[row] += len(pieces) - 1
            parts += pieces
            owners += [row] * len(pieces)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), at, np.array(owners)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; over_limit: more than `limit` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            data, offsets = flat(batch.column(1))
            counts = [np.zeros(0, np.int64)] + [counter.counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(np.concatenate(counts))], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
