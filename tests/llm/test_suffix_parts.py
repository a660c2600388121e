"""Parts too large for a task give what brute force gives, and none reaches a single task."""

from __future__ import annotations

import random

from timberline.llm import suffix_dedup

from . import plain


def none_large(*_):
    raise AssertionError("a large part in one task")


def test_large_parts_are_spread(spark, monkeypatch):
    rng = random.Random(11)
    passage = plain.sentence(rng, 30)
    texts = [f"{plain.sentence(rng, 3)} {passage} {plain.sentence(rng, 3)}" for _ in range(40)]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 100)
    monkeypatch.setattr(suffix_dedup, "repeats_by_digest", none_large)
    docs = plain.table(spark, [(k, t, None) for k, t in enumerate(texts)]).repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut(docs, 100).collect()}
    assert got == dict(enumerate(plain.cut(texts, 100)))
