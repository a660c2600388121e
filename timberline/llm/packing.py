"""Operator 13: packing token ids of documents into windows, best fit decreasing.

A document's ids, closed by an end id, are first cut into full windows; only
the rest of fewer ids is packed.  A task pools the rests of its documents and
packs each pool of bounded size: rests are taken by descending length, and a
segment tree over remaining capacities finds the tightest open window for each.
Windows with a small gap are given out, the pieces of others go back to the
pool for the next round.  What is still loose when a task ends is cut: laid end
to end over full windows, the last of them over powers of two, which need no
padding.  So the padding of a window is at most `gap` ids, whatever lengths
the documents have, and few documents are cut.

Packing needs no shuffle: a pool is a part of one task's rows, so it neither
grows with the input nor gathers a key.  A sequence's number holds that of its
task and recurs when the task runs again, as long as the order of the rows
read is fixed; rows of an order that isn't should be written first.

Defined results: null and empty texts have the end id alone; repeated rows are
packed each; null ids of documents pass through; special strings inside texts
become their ids, as in the library of .json vocabularies; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import merges
from .batches import blocks, flat
from .byte_bpe import Codec, codec

#: Ids of a sequence at most.
WINDOW = 2048
#: Rests that are packed together.
POOL_PIECES = 8192
#: Id that closes each document.
END_ID = 1

Piece = tuple[int, int, int, bytes]  # number of the document, ids before it, ids of the document, ids as little-endian u4


class Capacities:
    """Open windows by remaining capacity: a segment tree whose leaves count them finds the least capacity that suffices."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, leaf: int, by: int) -> None:
        while leaf:
            self.count[leaf] += by
            leaf >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(self.size + capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of a tightest window with room for `least` ids, which is taken out; None if there is none."""
        count, at = self.count, self.size + least
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._add(at, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indices of the pieces of each window; no length is above `window`."""
    open_windows, out = Capacities(window), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = open_windows.take(lengths[k])
        if found is None:
            found = window, len(out)
            out.append([])
        room, at = found
        out[at].append(k)
        if room > lengths[k]:
            open_windows.put(room - lengths[k], at)
    return out


def padded_length(n: int, window: int = WINDOW) -> int:
    """Ids of a sequence of n ids with its padding."""
    return n if n & (n - 1) == 0 else window


def _filled(pieces: list[Piece], sizes: Iterator[int]) -> Iterator[list[Piece]]:
    """The pieces end to end, cut so that each sequence has the next of `sizes`."""
    held, room = [], next(sizes)
    for doc, start, total, ids in pieces:
        while len(ids) // 4 > room:
            held.append((doc, start, total, ids[: 4 * room]))
            yield held
            start, ids = start + room, ids[4 * room :]
            held, room = [], next(sizes)
        held.append((doc, start, total, ids))
        room -= len(ids) // 4
        if not room:
            yield held
            held, room = [], next(sizes, 0)


def _sizes(total: int, window: int) -> Iterator[int]:
    """Full windows, then the powers of two that make up the rest."""
    for _ in range(total // window):
        yield window
    rest = total % window
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            yield 1 << bit


def packed(pieces: Iterator[Piece], window: int, pool_pieces: int, gap: int) -> Iterator[list[Piece]]:
    """Sequences of a task's pieces; none leaves more than `gap` ids open unless its length is a power of two."""
    pool: list[Piece] = []

    def rounds(last: bool) -> Iterator[list[Piece]]:
        loose: list[Piece] = []
        for at in best_fit([len(p[3]) // 4 for p in pool], window):
            n = sum(len(pool[k][3]) // 4 for k in at)
            if padded_length(n, window) - n <= gap:
                yield [pool[k] for k in at]
            else:
                loose += [pool[k] for k in at]
        pool.clear()
        if loose and (last or len(loose) > pool_pieces // 2):
            total = sum(len(p[3]) // 4 for p in loose)
            yield from _filled(loose, _sizes(total, window))
        else:
            pool.extend(loose)

    for piece in pieces:
        if len(piece[3]) == 4 * window:
            yield [piece]
            continue
        pool.append(piece)
        if len(pool) >= pool_pieces:
            yield from rounds(False)
    if pool:
        yield from rounds(True)


def _with_special(c: Codec, vocabulary: str, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """Ids of each text; special strings of the vocabulary become one id each."""
    special = merges.special_ids(vocabulary)
    raw = data.tobytes()
    if not any(s in raw for s in special):
        yield from c.encode_all(data, offsets)
        return
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        parts: list[bytes | int] = [raw[a:b]]
        for s, number in special.items():
            parts = [q for p in parts for q in ([p] if isinstance(p, int) else [x for y in p.split(s) for x in (number, y)][1:])]
        texts = [p for p in parts if not isinstance(p, int)]
        at = np.concatenate([[0], np.cumsum([len(p) for p in texts])]).astype(np.int64)
        ids = c.encode_all(np.frombuffer(b"".join(texts), np.uint8), at)
        yield b"".join(p.to_bytes(4, "little") if isinstance(p, int) else next(ids) for p in parts)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, pool_pieces: int = POOL_PIECES, gap: int | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids binary) of every piece.

    start: the document's ids before the piece; offset: its place in the
    sequence; ids: little-endian unsigned 32-bit integers, left out without
    `with_ids`; gap: ids of padding of a window at most, a 64th of it if None.
    """
    most = window // 64 if gap is None else gap
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, first = codec(vocabulary), TaskContext.get().partitionId() << 33
        names: dict[int, object] = {}  # ids of documents that have pieces in the pool
        open_pieces: dict[int, int] = {}

        def pieces() -> Iterator[Piece]:
            number = 0
            for batch in batches:
                data, offsets = flat(batch.column(1))
                for a, b in blocks(offsets):
                    for row, ids in enumerate(_with_special(c, vocabulary, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a):
                        ids += end
                        names[number], total = batch.column(0)[row].as_py(), len(ids) // 4
                        open_pieces[number] = total
                        for start in range(0, total, window):
                            yield number, start, total, ids[4 * start : 4 * (start + window)]
                        number += 1

        rows: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [id_type, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=False)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

        for k, sequence in enumerate(packed(pieces(), window, pool_pieces, most)):
            at = 0
            for doc, start, total, ids in sequence:
                rows.append((names[doc], start, len(ids) // 4, zlib.crc32(ids), total, first + k, at, *[ids] * with_ids))
                at += len(ids) // 4
                size += len(ids) * with_ids
                open_pieces[doc] -= len(ids) // 4
                if not open_pieces[doc]:
                    del open_pieces[doc], names[doc]
            if len(rows) >= 10_000 or size > 1 << 24:
                yield batch_of()
                rows, size = [], 0
        if rows:
            yield batch_of()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = _arrow(rows)
    out = f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def _arrow(rows: DataFrame) -> pa.DataType:
    return rows.select("id").limit(0).toArrow().schema.field(0).type


def sequences(pieces: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, n_ids, padded_length, ids, pieces) of each sequence of pack(): ids joined in order, pieces as (id, start, length, offset); a sequence has `window` pieces at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(id_col).alias("id"), "start", "length", "ids")))
    out = pieces.groupBy("sequence_id").agg(parts.alias("_parts"), F.sum("length").alias("n_ids"))
    ids = F.aggregate("_parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    power = F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) == 0
    listed = F.transform("_parts", lambda p: F.struct(p["id"].alias("id"), p["start"].alias("start"), p["length"].alias("length"), p["offset"].alias("offset")))
    return out.select("sequence_id", "n_ids", F.when(power, F.col("n_ids")).otherwise(window).cast("long").alias("padded_length"), ids.alias("ids"), listed.alias("pieces"))
