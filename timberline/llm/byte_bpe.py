"""Operator 6: byte-level BPE encoding and decoding.

Boundaries of pre-tokens come from codepoint-class arrays and an associative
scan over transition functions (`pretoken`); the slices between them go
through pair merging behind a cache of bounded size.  Ids are kept as
little-endian unsigned 32-bit integers together with the byte offset of every
token, so each text can be decoded and each token traced to its span.

Defined results: null and empty texts give no ids; repeated rows give repeated
results; null ids of documents pass through; no text is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import merges, pretoken
from .batches import blocks, flat


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.ranks = merges.load_ranks(path)
        self.pairs = merges.PairTable(self.ranks)
        self.cache: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        starts, owner = pretoken.split(data, offsets)
        raw, cache = data.tobytes(), self.cache
        cuts = [*starts.tolist(), len(raw)]
        pieces = [raw[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
        missing = [p for p in dict.fromkeys(pieces) if p not in cache]
        if len(cache) + len(missing) > merges.CACHE_ENTRIES:
            cache = self.cache = {}
            missing = list(dict.fromkeys(pieces))
        cache.update(zip(missing, self.pairs.merge_all(missing), strict=True))
        ids, owner = [cache[p] for p in pieces], owner.tolist()
        for a, b in zip(owner, owner[1:], strict=False):
            yield b"".join(ids[a:b])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset at which each token starts in its text."""
        sizes = self.lengths[np.frombuffer(ids, "<u4")]
        return np.cumsum(sizes) - sizes


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and file, so that its cache outlives a task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, token_offsets binary): ids as little-endian u4, offsets of token starts in bytes as little-endian u4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets):
                ids = list(c.encode_all(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                at = [c.offsets(x).astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(at, pa.binary())], ["id", "ids", "token_offsets"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, token_offsets binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text binary): the bytes that the ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            out = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids and digests both in one pass, so that ids need not leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            counts, encoded, decoded = [], [], []
            for a, b in blocks(offsets):
                for ids in c.encode_all(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    counts.append(len(ids) // 4)
                    encoded.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
