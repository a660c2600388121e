"""Learned operators: their counts by brute force, their constraints, and accuracy on rows they did not see."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from timberline.llm import language_id, quality_classifier, quality_rules, queries, samples
from timberline.llm.text_statistics import RATIOS

from . import plain


@pytest.fixture(scope="module")
def larger(sf) -> str:
    return sf.replace("sf0.001", "sf0.01")


def test_base_counts_are_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in plain.rows_of(spark, sf)}
    for r in queries.op2_quality_rules(spark, sf).collect():
        want = plain.base_counts(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, r.doc_id
        assert r.kept == (not r.base_failed and r.score >= 0.5)


def test_base_counts_of_edges(spark):
    docs = plain.table(spark, plain.edge_rows())
    texts = dict(r[:2] for r in plain.edge_rows())
    for r in quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).collect():
        want = plain.base_counts(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, r.doc_id
        assert r.kept == (not r.base_failed)


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(RATIOS)))
    names = list(RATIOS)
    y = (x[:, names.index("letters")] + 0.3 * x[:, names.index("symbols")] + rng.normal(0, 0.2, 3000) > 0.7).astype(float)
    trees = quality_rules.fit(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8
    for name, sign in quality_rules.MONOTONE.items():
        k = names.index(name)
        some = np.repeat(x[:100], 20, 0)
        some[:, k] = np.tile(np.linspace(0, 1, 20), 100)
        step = np.diff(trees.score(some).reshape(100, 20), axis=1) * sign
        assert (step >= -1e-12).all(), name


def test_rules_follow_the_labels(spark, larger):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    got = [(r.kept, labels[r.doc_id]) for r in queries.op2_quality_rules(spark, larger).collect() if labels.get(r.doc_id) is not None and not r.base_failed]
    assert np.mean([k == bool(y) for k, y in got]) > 0.9


def test_weak_labels_find_good_texts(spark, larger):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    got = [(r.kept, labels[r.doc_id]) for r in queries.op4_quality_classifier(spark, larger).collect() if labels.get(r.doc_id) is not None]
    good, bad = [k for k, y in got if y], [k for k, y in got if not y]
    assert np.mean(good) > 0.95
    assert np.mean(bad) < 0.5


def test_posteriors_estimate_accuracies():
    rng = np.random.default_rng(4)
    n, m = 20_000, len(quality_classifier.LABELLERS)
    truth = rng.random(n) < 0.7
    right = np.linspace(0.6, 0.95, m)
    vote = np.where(rng.random((n, m)) < 0.4, 0, np.where((rng.random((n, m)) < right) == truth[:, None], 2, 1))
    value, back, count = np.unique(quality_classifier.pattern(vote), return_inverse=True, return_counts=True)
    p = quality_classifier.posteriors(value, count)[back]
    assert ((p > 0.5) == truth).mean() > 0.9


def test_language_on_held_out_rows(spark, larger):
    rows = {r.doc_id: r for r in plain.rows_of(spark, larger)}
    got = queries.op7_language_id(spark, larger).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        letters = any(c.isalpha() for c in rows[r.doc_id].text or "")
        assert (r.lang_pred == "und") == (not letters)
    held = [r.lang_pred == rows[r.doc_id].lang for r in got if r.held_out and rows[r.doc_id].lang and r.lang_pred != "und"]
    assert np.mean(held) > 0.95


def test_repeated_ids_do_not_empty_the_sample(spark, monkeypatch):
    """One id for all rows, more rows than the sample holds."""
    monkeypatch.setattr(quality_classifier, "SAMPLE_ROWS", 50)
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 50)
    texts = [("the quick brown fox and the lazy dog number " + str(k % 7), "en") for k in range(300)] + [("der schnelle braune fuchs und der faule hund nummer " + str(k % 7), "de") for k in range(300)]
    docs = spark.createDataFrame([(1, t, lang) for t, lang in texts], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(docs).collect()} == {"en", "de"}
    assert all(0 < r.score < 1 for r in quality_classifier.classify(docs).collect())


def test_long_texts_add_up_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    table = rng.normal(size=(language_id.BUCKETS, 3))
    whole = language_id.text_logits(table, data, np.array([0, len(data)]))
    monkeypatch.setattr(language_id, "BLOCK_BYTES", 777)
    assert np.array_equal(language_id.text_logits(table, data, np.array([0, len(data)])), whole)


def test_labels_of_one_id_are_learned_from(spark, monkeypatch):
    """More labelled rows than the sample holds, all of one id: trees grow, and reruns grow the same."""
    monkeypatch.setattr(quality_rules, "SAMPLE_ROWS", 150)
    docs = [(1, " ".join(plain.sentence(random.Random(k), 60 + k % 9) if k % 2 else f"# $ {k} spam spam spam" for _ in range(3)), None) for k in range(400)]
    table = plain.table(spark, docs)
    labels = spark.createDataFrame([(1, k % 2) for k in range(400)], "doc_id long, quality int")
    counts = quality_rules.statistics(table, "doc_id", "text")
    first, again = (quality_rules.learn(counts, labels) for _ in range(2))
    assert len(first.roots) == quality_rules.TREES
    assert all(np.array_equal(getattr(first, x), getattr(again, x)) for x in ("roots", "feature", "threshold", "left", "right", "value"))


def test_flat_trees_score_as_a_walk_does():
    """The descent of all rows together equals walking every tree from its root, row by row."""
    rng = np.random.default_rng(3)
    x = rng.random((700, len(RATIOS)))
    trees = quality_rules.fit(x, (x[:, 0] + x[:, 1] ** 2 > rng.random(700)).astype(float))

    def walk(row) -> float:
        total = trees.base
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = int(trees.left[node] if row[int(trees.feature[node])] <= trees.threshold[node] else trees.right[node])
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:200]), [walk(r) for r in x[:200]])


def test_scorer_equals_a_plain_sum():
    """Of each text the mean weight of its buckets, ratios within bounds, and the bias, one feature at a time."""
    rng = np.random.default_rng(8)
    n = len(RATIOS)
    scorer = quality_classifier.Scorer(rng.normal(size=quality_classifier.BUCKETS + n), 0.3, rng.random(n), rng.random(n) + 0.1)
    texts = [b"one two two THREE 4,5", b"", b"a" * 50, b"x y z x y z !"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ratio = rng.random((len(texts), n))
    for k, p in enumerate(scorer.score(data, at, ratio).tolist()):
        found, _ = quality_classifier.hashed(np.frombuffer(texts[k], np.uint8), np.array([0, len(texts[k])]))
        total = scorer.bias + (sum(scorer.weights[b] for b in found.tolist()) / len(found) if len(found) else 0)
        for j in range(n):
            total += max(-5, min(5, (ratio[k, j] - scorer.mean[j]) / scorer.scale[j])) * scorer.weights[quality_classifier.BUCKETS + j]
        assert abs(p - 1 / (1 + np.exp(-total))) < 1e-6


def test_logits_are_the_averaged_embeddings_through_the_layer():
    rng = np.random.default_rng(5)
    table = rng.normal(size=(language_id.BUCKETS, 3))
    texts = ["kurz", "ein etwas längerer text", "a"]
    raw = [t.encode() for t in texts]
    got = language_id.text_logits(table, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, logits in zip(raw, got, strict=True):
        found = language_id.buckets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist()
        mean = sum(table[b] for b in found) / max(1, len(found))
        assert np.allclose(logits, mean, atol=1e-5)


def test_windows_of_long_texts_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(samples, "SAMPLE_BYTES", 40)
    monkeypatch.setattr(samples, "WINDOW", 10)
    texts = ["short", None, *("".join(map(str, range(k, k + 200))) + "é" for k in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.text for r in samples.sample(rows, 1000, "s").collect()]
    assert len(got) == len(texts) and {"short", None} <= set(got)
    windows = [t for t in got if t and t != "short"]
    assert all(len(t) == 10 and any(t in x for x in texts[2:]) for t in windows)
    assert len({x.index(t) // 100 for t, x in ((t, next(x for x in texts[2:] if t in x)) for t in windows)}) > 4
    few = samples.sample(rows, 20, "s").collect()
    assert 0 < len(few) <= 40 and sorted(map(repr, few)) == sorted(map(repr, samples.sample(rows.repartition(5), 20, "s").collect()))
