"""Operator 3: exact substring deduplication with suffix arrays of shards.

Every byte that lies in a string of `length` bytes which also starts anywhere
else, in the same text or in another, is removed.

1.  Each string of `length` bytes of a text has an anchor: the leftmost of its
    K-byte grams with the least hash.  Strings that start one after the other
    and share their anchor form a run, cut in two by the anchor's offset so
    that all strings of a run hold the same long middle part.  Equal strings
    have equal middle parts, so only runs with the same middle part can share
    a string.
2.  A run is named by a digest of all its bytes.  Where two runs are equal all
    their strings repeat, and nothing but digests was moved; this settles
    copies of any number.
3.  Where unequal runs share a middle part, one of each is sent to the shard
    of that part.  A shard's runs are put in one string, its suffixes sorted
    by induced sorting, and the permuted common prefixes of the suffixes that
    are strings of a run tell which of them repeat.
4.  Repeated strings are joined to spans of each text and cut out.

A middle part with so many unequal runs that they exceed a shard is sorted by
digests of its strings instead, in memory in proportion to one offset.

Defined results: null and empty texts have 0 bytes and lose nothing; texts
shorter than `length` lose nothing; repeated rows lose all bytes if they are
long enough; strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .batches import blocks, flat
from .buckets import grouped, id_filter, may_hold
from .durable import written
from .suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 400
K = 32
#: Bytes of runs that are sorted together.
SHARD_BYTES = 2_000_000


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of all texts of a block: text index, first position, number of strings, middle part's digest, run's digest."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n, reach = len(data), length - K + 1
    if n < length:
        return none
    hasher = words.Hasher(data)
    at = np.arange(n - K + 1)
    # hash above position: the least is the least hash, and the leftmost of equal ones
    value = (hasher(at, at + K) & ~np.uint64((1 << 28) - 1)) | at.astype(np.uint64)
    full = -(-len(value) // reach) * reach
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    rows = padded.reshape(-1, reach)
    upto = np.minimum.accumulate(rows, 1).ravel()
    since = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    m = n - length + 1
    anchor = (np.minimum(since[:m], upto[reach - 1 : reach - 1 + m]) & np.uint64((1 << 28) - 1)).astype(np.int64)
    # strings that lie within one text
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(np.arange(m) + length <= offsets[text[:m] + 1])
    if not len(start):
        return none
    anchor, text = anchor[start], text[start]
    late = anchor - start > reach // 2
    change = np.ones(len(start), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (late[1:] != late[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(start)))
    low, anchor, late, text = start[first], anchor[first], late[first], text[first]
    # the part that all strings with this anchor and this half of offsets hold
    a = np.where(late, anchor - reach // 2 - 1, anchor)
    b = np.where(late, anchor + K, anchor + length - reach // 2)
    part = words.mix(hasher(a, b) + late.astype(np.uint64))
    whole = words.mix(hasher(low, low + count - 1 + length) ^ (part + (anchor - low).astype(np.uint64)))
    return text, low, count, part.view(np.int64), whole.view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text): row names rows of equal id and text alike, which lose the same bytes."""
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(F.col(id_col).cast("string"), text, F.octet_length(text)).alias("row"), text.alias("text"))


def runs(rows: DataFrame, length: int) -> DataFrame:
    """(part, run, row, low, n) of every run."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets):
                at = offsets[a : b + 1] - offsets[a]
                text, low, n, part, run = runs_of(data[offsets[a] : offsets[b]], at, length)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(run), batch.column(0).slice(a, b - a).take(pa.array(text)), pa.array(low - at[text]), pa.array(n.astype(np.int32))], ["part", "run", "row", "low", "n"])

    return rows.mapInArrow(find, "part long, run long, row long, low long, n int")


def run_bytes(rows: DataFrame, wanted: np.ndarray, length: int) -> DataFrame:
    """(part, run, n, bytes) of the runs whose middle part the filter may hold, one of each run and task."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in blocks(offsets):
                block = data[offsets[a] : offsets[b]]
                _, low, n, part, run = runs_of(block, offsets[a : b + 1] - offsets[a], length)
                some = np.flatnonzero(may_hold(sent.value, part))
                _, first = np.unique(run[some], return_index=True)
                some = some[first]
                raw = block.tobytes()
                texts = [raw[x : x + k - 1 + length] for x, k in zip(low[some].tolist(), n[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[some]), pa.array(run[some]), pa.array(n[some].astype(np.int32)), pa.array(texts, pa.binary())], ["part", "run", "n", "bytes"])

    return rows.select("text").mapInArrow(find, "part long, run long, n int, bytes binary")


def repeats(pieces: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each piece, which of its first `count` strings also start in another piece: by suffix array and common prefixes."""
    sizes = np.array([len(p) + 1 for p in pieces])
    base = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8).astype(np.int16) + 1
    joined[base + sizes - 1] = 0  # parts two pieces; no text has it
    starts = np.concatenate([np.arange(c) + b for b, c in zip(base.tolist(), counts, strict=True)])
    is_start = np.zeros(len(joined), bool)
    is_start[starts] = True
    order = suffix_array(joined, length)
    order = order[is_start[order]]
    common = permuted_common_prefixes(words.Hasher(joined), order, length)
    again = np.zeros(len(joined), bool)
    equal = common[order] >= length  # to the suffix before it
    again[order[equal]] = True
    again[order[:-1][equal[1:]]] = True
    return [again[b : b + c] for b, c in zip(base.tolist(), counts, strict=True)]


def repeats_by_digest(pieces: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """The same for pieces of one middle part, by sorting digests of their strings."""
    digests = []
    for p, c in zip(pieces, counts, strict=True):
        at = np.arange(c)
        digests.append(words.Hasher(np.frombuffer(p, np.uint8))(at, at + length))
    _, back, times = np.unique(np.concatenate(digests), return_inverse=True, return_counts=True)
    again = times[back] > 1
    ends = np.cumsum(counts)
    return [again[e - c : e] for e, c in zip(ends.tolist(), counts, strict=True)]


def spans_of(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"at": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def settled(texts: DataFrame, length: int) -> DataFrame:
    """(run, again): stretches of strings of each run that repeat in another run of its middle part."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
        for table in grouped(batches):
            part = table.column(0).to_numpy()
            names, counts, pieces = table.column(1).to_pylist(), table.column(2).to_pylist(), table.column(3).to_pylist()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            size = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            a = 0
            while a < len(cuts) - 1:
                b = a + 1
                while b < len(cuts) - 1 and size[cuts[b + 1]] - size[cuts[a]] <= SHARD_BYTES:
                    b += 1
                x, y = cuts[a], cuts[b]
                a = b
                solver = repeats if size[y] - size[x] <= SHARD_BYTES else repeats_by_digest
                found = [spans_of(f) for f in solver(pieces[x:y], counts[x:y], length)]
                keep = [k for k, f in enumerate(found) if f]
                yield pa.RecordBatch.from_arrays([pa.array([names[x + k] for k in keep], pa.int64()), pa.array([found[k] for k in keep], kind)], ["run", "again"])

    name, count, piece = texts.columns[1:4]
    large = texts.groupBy("part").agg(F.sum(F.octet_length(piece)).alias("bytes")).filter(F.col("bytes") > SHARD_BYTES).select("part")
    large = written(large)
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not put together by size: a part takes long for its bytes
    small = texts.join(large, "part", "left_anti").repartition(tasks, "part").sortWithinPartitions("part", "run").mapInArrow(solve, "run long, again array<struct<at: int, n: int>>")
    return small.union(settled_apart(texts.join(large, "part", "left_semi").select("part", name, count, piece), length))


def settled_apart(texts: DataFrame, length: int) -> DataFrame:
    """As settled(), for parts too large for a task: the digests of all strings are counted by Spark."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, run, n, piece in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for low in range(0, n, 100_000):
                    at = np.arange(low, min(n, low + 100_000))
                    h = words.Hasher(np.frombuffer(piece, np.uint8)[low : at[-1] + length])(at - low, at - low + length).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part)), pa.array(h), pa.array(np.full(len(at), run)), pa.array(at.astype(np.int32))], ["part", "digest", "run", "at"])

    rows = texts.mapInArrow(digests, "part long, digest long, run long, at int")
    again = rows.groupBy("part", "digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("part", "digest")
    starts = rows.join(again, ["part", "digest"]).groupBy("run").agg(F.collect_set("at").alias("at"))
    return starts.select("run", F.transform("at", lambda x: F.struct(x.alias("at"), F.lit(1).alias("n"))).alias("again"))


def spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, starts): stretches (at, n) of starts of repeated strings, for each row that has any."""
    rows = _rows(docs, id_col, text_col)
    found = written(runs(rows, length))
    kinds = written(found.groupBy("part", "run").agg(F.count(F.lit(1)).alias("times"), F.first("n").alias("n")))
    parts = kinds.groupBy("part").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("part")
    parts = written(parts)
    texts = run_bytes(rows, id_filter(parts, "part"), length).join(parts, "part", "left_semi").dropDuplicates(["part", "run"])
    partly = settled(written(texts), length)
    wholly = kinds.filter("times > 1").select("run", F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("n"))).alias("again"))
    marks = found.join(wholly.union(partly), "run").select("row", "low", F.explode("again").alias("x")).select("row", F.struct((F.col("low") + F.col("x.at")).alias("at"), F.col("x.n").cast("long").alias("n")).alias("x"))
    return marks.groupBy("row").agg(F.collect_set("x").alias("starts"))


def covered(starts: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start in the given stretches."""
    out: list[list[int]] = []
    for x in sorted((s["at"], s["at"] + s["n"] - 1 + length) for s in starts):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [(a, b) for a, b in out]


def cut(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, removed_spans) of every row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), text, F.octet_length(text)).alias("row"), text.alias("text"))
    joined = rows.join(spans(docs, length, id_col, text_col), "row", "left").select("id", F.col("text").cast("binary").alias("text"), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                out: list[list] = [[] for _ in kinds]
                for raw, starts in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                    raw = raw or b""
                    gone = covered(starts or [], length)
                    edges = [0, *(x for s in gone for x in s), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    row = (len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in gone])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed_spans"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed_spans array<struct<start: long, end: long>>"
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
