"""Token counts and byte-level BPE against the libraries of the vocabularies."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest
import tiktoken
import unicodedata
from tokenizers import Tokenizer

import public_tokenizers
from timberline.llm import byte_bpe, token_counts
from timberline.llm.queries import TOKENIZERS

from . import plain


def odd_texts() -> list[str]:
    rng = random.Random(11)
    alphabet = [*"abc ABC'stredlvm  \n\t\r0129.,!?-_#", "é", " ", " ", "世", "́", "½", "\U0001f600", "\x00", "\x85", "　"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(120))) for _ in range(400)]
    beyond = [chr(c) for c in range(0x80, 0x30000, 7) if unicodedata.category(chr(c)) != "Cs"]
    texts += [" ".join(beyond[k::100]) + "".join(beyond[k::100]) for k in range(100)]
    return [*texts, "<|endoftext|>", "a<|endoftext|> <|endoftext|>b<|endoftext|", "x" * 3000, " " * 3000, "don't we'll I'VE '''sss"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in plain.rows_of(spark, sf)] + [(10_000 + k, t, "x") for k, t in enumerate(odd_texts())] + [(-r[0], r[1], r[2]) for r in plain.edge_rows()]
    return plain.table(spark, rows).repartition(4).cache()


def test_counts_are_the_librarys(docs):
    library = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    got = token_counts.count_tokens(docs, f"{TOKENIZERS}/byte_bpe_50k.json").collect()
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512), r.doc_id


def test_few_states_give_the_same(monkeypatch):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    library, counter = Tokenizer.from_file(path), token_counts.Counter(path)
    counter.machine.max_states = 300
    for t in odd_texts()[:150]:
        raw = np.frombuffer(t.encode(), np.uint8)
        assert counter.counts(raw, np.array([0, len(raw)]))[0] == len(library.encode(t, add_special_tokens=False).ids)


def test_round_trip_is_the_librarys(docs):
    path = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in byte_bpe.round_trip_digests(docs, path).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha(texts[r.doc_id].encode())), r.doc_id


def test_offsets_and_decoding(docs):
    path = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    some = docs.filter("doc_id < 60")
    encoded = byte_bpe.encode(some, path).cache()
    texts = {r.doc_id: (r.text or "").encode() for r in some.select("doc_id", "text").collect()}
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded, path).collect()} == texts
    tokens = byte_bpe.codec(path).tokens
    for r in encoded.collect():
        at = np.frombuffer(r.token_offsets, "<u4").tolist()
        for k, s in zip(np.frombuffer(r.ids, "<u4").tolist(), at, strict=True):
            assert texts[r.doc_id][s : s + len(tokens[k])] == tokens[k]
