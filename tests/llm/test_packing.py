"""Packing: every id in one piece, windows gapless and nearly full, ids as the library gives them."""

from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from timberline.llm import packing
from timberline.llm.queries import TOKENIZERS

from . import plain

FILE = f"{TOKENIZERS}/byte_bpe_50k.json"


def whole(rows, ids_of, window):
    """Asserts what holds for every packing; returns the share of padding."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        ids, at = ids_of[doc], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = used = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += packing.padded_length(at, window) - at
        used += at
    return padding / used


def library(texts):
    t = Tokenizer.from_file(FILE)
    return {doc: [*t.encode(text or "", add_special_tokens=False).ids, 1] for doc, text in texts.items()}


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert whole(packing.pack(docs, FILE, with_ids=False).collect(), library(texts), 2048) < 0.01


def test_edges(spark):
    rows = [r for r in {r[0]: r for r in plain.edge_rows()}.values()] + [(20, "<|endoftext|>a<|endoftext|><|endoftext|> b", "a"), (21, "<|endoftext|>", None)]
    docs = plain.table(spark, rows)
    assert whole(packing.pack(docs, FILE).collect(), library({r[0]: r[1] for r in rows}), 2048) < 0.01


@pytest.mark.parametrize("length", [1, 500, 1100, 2047])
def test_lengths_that_do_not_fit_each_other(length):
    """Where no two rests fit one window, loose windows are cut, not padded."""
    pieces = [(k, 0, length, b"\0\0\0\0" * length) for k in range(3000)]
    sizes = [sum(len(p[3]) // 4 for p in s) for s in packing.packed(iter(pieces), 2048, 1000, 32)]
    assert sum(sizes) == 3000 * length and max(sizes) <= 2048
    assert sum(packing.padded_length(n) - n for n in sizes) <= 32 * len(sizes)


def test_best_fit_is_the_tightest():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 120))]
        rooms: list[int] = []
        want: list[list[int]] = []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [r for r in rooms if r >= lengths[k]]
            at = rooms.index(min(fits)) if fits else len(rooms)
            if not fits:
                rooms.append(100)
                want.append([])
            rooms[at] -= lengths[k]
            want[at].append(k)
        got = packing.best_fit(lengths, 100)
        assert len(got) == len(want)
        assert sorted(100 - sum(lengths[k] for k in w) for w in got) == sorted(rooms)


def test_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    pieces = packing.pack(docs, FILE, window=256, pool_pieces=16)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids_of = library(texts)
    assert whole(pieces.collect(), ids_of, 256) < 0.05
    for s in packing.sequences(pieces, 256).collect():
        want = [x for p in s.pieces for x in ids_of[p.id][p.start : p.start + p.length]]
        assert list(struct.unpack(f"<{s.n_ids}I", s.ids)) == want
        assert s.padded_length == packing.padded_length(s.n_ids, 256)
        assert [p.offset for p in s.pieces] == sorted(p.offset for p in s.pieces)
