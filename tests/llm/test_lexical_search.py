"""Ranked search against SQL and against a score of every pair."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tests.compare import agree
from timberline.llm import lexical_search, queries

from . import plain

TERM = re.compile(lexical_search.TERM)


def terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(items: list[tuple], docs: list[tuple], k: int) -> list[tuple]:
    """(item, rank, doc, score), by the formula, for every pair of an item and a document."""
    held = [(doc, Counter(terms(text))) for doc, text in docs]
    held = [(doc, tf) for doc, tf in held if tf]
    n_docs, n_terms = len(held), sum(sum(tf.values()) for _, tf in held)
    df = Counter(t for _, tf in held for t in tf)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in wanted.items():
        scored = []
        for doc, tf in held:
            m = 100 - 75 + (75 * sum(tf.values()) * n_docs) // n_terms
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, c in q.items() if t in tf)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        out += [(item, rank, doc if there else None, -score) for rank, (score, there, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(frame) -> list[tuple]:
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


def test_agrees_with_sql(spark, sf):
    assert agree(spark, queries.op11_lexical_search, lexical_search.sql(), sf) > 0


@pytest.mark.parametrize("seed, first", [(1, 2000), (2, 1), (3, 30)])
def test_every_pair(spark, monkeypatch, seed, first):
    """Wherever the bound lies, no result and no tie is lost; common terms, repeats and copies included."""
    monkeypatch.setattr(lexical_search, "FIRST_MATCHES", first)
    rng = random.Random(seed)
    vocabulary = [f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(3000)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 40, 200])))) for k in range(300)]
    docs += [(300 + k, docs[7][1]) for k in range(25)] + [(7, docs[7][1]), (400, None), (401, ""), (402, "-- ! "), (None, docs[7][1])]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 30])))) for k in range(25)]
    items += [(30, docs[7][1]), (31, "W1, w1 w2"), (31, "w3"), (32, None), (33, "absent"), (None, docs[9][1])]
    table = plain.table(spark, [(i, t, "s") for i, t in docs])
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, term string, doc_id string")
    assert got(lexical_search.search(asked, table)) == by_hand(items, docs, 10)
    assert got(lexical_search.search(asked, table, k=3)) == by_hand(items, docs, 3)


def test_stored_index(spark):
    docs = [(k, text) for k, text in enumerate(["a b c", "a b", "a", "C c c é", "Ünder é", None])]
    table = plain.table(spark, [(i, t, "s") for i, t in docs])
    postings = lexical_search.index(table)
    assert postings.filter("bucket >= 0").count() == sum(len(set(terms(t))) for _, t in docs)
    for text in ("b c", "é", "Ünder", "z"):
        asked = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert got(lexical_search.search(asked, table, postings=postings)) == by_hand([(1, text)], docs, 10)


def test_empty(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert lexical_search.search(items.limit(0), docs).count() == 0
    assert lexical_search.search(items, docs.limit(0)).count() == 0
    assert lexical_search.search(items, spark.createDataFrame([(None, None)], "doc_id long, text string")).count() == 0
