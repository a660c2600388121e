"""Exact substrings, fuzzy lines and n-gram links against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from timberline.llm import edit_similarity, line_dedup, ngram_join, queries, suffix_dedup
from timberline.llm.suffix_array import suffix_array

from ..compare import agree
from . import plain


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_suffix_array_is_sorted(letters):
    rng = np.random.default_rng(letters)
    t = np.append(rng.integers(1, letters + 1, 700), 0).astype(np.int16)
    assert suffix_array(t, len(t)).tolist() == sorted(range(len(t)), key=lambda k: t[k:].tolist())


def test_cut_is_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in plain.rows_of(spark, sf)]
    want = {i: x for (i, _), x in zip(rows, plain.cut([t for _, t in rows], 400), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op3_suffix_dedup(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_cut_with_shared_passages(spark, seed):
    rng = random.Random(seed)
    passages = [plain.sentence(rng, rng.randrange(5, 40)) for _ in range(8)]
    texts = [" ".join(rng.choice(passages) if rng.random() < 0.5 else plain.sentence(rng, rng.randrange(30)) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    texts += ["ab" * 150, "z" * 300, "z" * 101, "z" * 100, texts[0], None, "", "é世" * 60]
    docs = plain.table(spark, [(k, t, None) for k, t in enumerate(texts)]).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut(docs, 100).collect()}
    assert got == dict(enumerate(plain.cut(texts, 100)))


def test_digest_fallback_is_the_suffix_arrays(spark, monkeypatch):
    rng = random.Random(5)
    core = plain.sentence(rng, 60)
    pieces = [(plain.sentence(rng, 3) + core + plain.sentence(rng, 3)).encode() for _ in range(30)]
    pieces.append(pieces[3][:-4] + b"1234")
    counts = [len(p) - 99 for p in pieces]
    one, two = suffix_dedup.repeats(pieces, counts, 100), suffix_dedup.repeats_by_digest(pieces, counts, 100)
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


def test_links_agree_with_sql(spark, sf):
    agree(spark, queries.op8_ngram_join, queries.oracle_sql()["op8_ngram_join"], sf)


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 50, 3)])
def test_links_are_brute_force(spark, n, percent, seed):
    rng = random.Random(seed)
    texts: list = [None, "", " ", "One two", "one TWO", "one"]
    for _ in range(25):
        base = plain.sentence(rng, rng.randrange(3, 120)).split()
        for _ in range(rng.randrange(1, 8)):
            again = [f"x{rng.randrange(99)}" if rng.random() < 0.02 else w for w in base]
            texts.append(" ".join(again[: rng.randrange(max(1, len(again) - 6), len(again) + 1)]))
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    got = ngram_join.similar_components(plain.table(spark, [(i, t, None) for i, t in rows]).repartition(4), n, percent).collect()
    assert Counter(map(tuple, got)) == Counter(plain.components(rows, n, percent))


def test_keep_first_leaves_one_of_each(spark):
    rows = plain.edge_rows()
    docs = plain.table(spark, rows)
    kept = Counter(r.doc_id for r in ngram_join.keep_first(docs).collect())
    want = {i for i, _, c in plain.components([r[:2] for r in rows], 5, 80) if i == c}
    assert set(kept) == want


def test_edit_similarity():
    rng = random.Random(1)
    for _ in range(500):
        a = "".join(rng.choices("abé c", k=rng.randrange(0, rng.choice([3, 30, 66, 140]))))
        b = "".join(x for x in a if rng.random() > 0.15) + "".join(rng.choices("ab", k=rng.randrange(3)))
        longest = max(len(a), len(b))
        assert edit_similarity.similar(a.encode(), b.encode(), 0.8) == (5 * plain.edit_distance(a, b) <= longest)


def may_be_similar(x: str, y: str) -> bool:
    return 5 * abs(len(x) - len(y)) <= max(len(x), len(y))


@pytest.mark.parametrize("n", [1, 64, 65, 200, 700])
def test_edit_similarity_of_many_pairs(n):
    rng = random.Random(n)
    left = ["".join(rng.choices("abcde ", k=rng.randrange(n, n + 9))) for _ in range(30)]
    right = ["".join(c for c in x if rng.random() > rng.choice([0.1, 0.2])) + "b" for x in left]
    got = edit_similarity.similar_pairs([x.encode() for x in left], [y.encode() for y in right], 0.8)
    assert got.tolist() == [5 * plain.edit_distance(x, y) <= max(len(x), len(y)) for x, y in zip(left, right, strict=True)]


def test_two_bits_are_always_candidates():
    """By the pigeonhole principle."""
    rng = random.Random(2)
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(64), 2))
        assert sum(not differ >> s & 0xFFFF for s in line_dedup.BLOCKS) >= 2


def test_normal_lines():
    rng = random.Random(3)
    for _ in range(100):
        raw = ["".join(rng.choices("aB 10\n\t.é9 ", k=rng.randrange(40))).encode() for _ in range(rng.randrange(1, 6))]
        text, number, normal, at = line_dedup.normal_lines(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        got = [(int(i), int(k), normal[at[j] : at[j + 1]].tobytes()) for j, (i, k) in enumerate(zip(text, number, strict=True))]
        assert got == [(i, k, b" ".join(re.sub(rb"[0-9]+", b"0", x.lower()).split())) for i, t in enumerate(raw) for k, x in enumerate(t.split(b"\n"))]


def test_lines_are_brute_force(spark):
    rng = random.Random(9)
    bases = [plain.sentence(rng, rng.randrange(8, 16), "word") for _ in range(40)]
    rows: list = [(0, None), (1, ""), (2, "\n\n"), (3, "a b\na b\nA  B\nc 12\nc 7")]
    for i in range(4, 60):
        lines = []
        for _ in range(rng.randrange(1, 12)):
            line = rng.choice(bases)
            if rng.random() < 0.3:
                line = line + "."
            if rng.random() < 0.3:
                line = line.upper()
            lines.append(line if rng.random() < 0.6 else plain.sentence(rng, 10, "other"))
        rows.append((i, "\n".join(lines)))
    # digits are all alike to a line, so words differ in letters
    letters = str.maketrans("0123456789", "bcdfghjklm")
    rows = [(i, t if t is None or i < 4 else t.translate(letters)) for i, t in rows]
    docs = plain.table(spark, [(i, t, None) for i, t in rows]).repartition(4)
    got = {r.id: set(r.lines) for r in line_dedup.removals(docs).collect()}
    want = plain.line_groups(rows, 1, may_be_similar)
    assert got == want
    texts = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    for i, t in rows:
        kept = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ()))
        assert texts[i] == kept
    for r in line_dedup.report(docs).collect():
        t = dict(rows)[r.doc_id]
        assert (r.n_lines, r.n_removed, r.kept_sha256) == (0 if t is None else len(t.split("\n")), len(want.get(r.doc_id, ())), plain.sha((texts[r.doc_id] or "").encode()))


@pytest.mark.parametrize("letters", ["abcdefgh ", "".join(map(chr, range(0x4E00, 0x5200)))])
def test_long_pairs_are_compared_together(letters, monkeypatch):
    """Pairs of many lengths; only those that nearly agree, or whose letters are too many, are compared one by one."""
    rng, alone = random.Random(12), []
    one = edit_similarity._one
    monkeypatch.setattr(edit_similarity, "_one", lambda *x: alone.append(x) or one(*x))
    left = ["".join(rng.choices(letters, k=rng.randrange(520, 700))) for _ in range(120)]
    right = ["".join(rng.choices(letters, k=len(x))) for x in left]
    for k in range(0, 120, 20):  # copies with changes around the bound
        right[k] = "x" + "".join(c if rng.random() > (0.15, 0.19, 0.2, 0.21, 0.25, 0.05)[k // 20] else rng.choice(letters) for c in left[k])
    got = edit_similarity.similar_pairs([x.encode() for x in left], [y.encode() for y in right], 0.8)
    assert got.tolist() == [one(y, x, int(0.2 * max(len(x), len(y)) + 1e-9)) for x, y in zip(left, right, strict=True)]
    assert 0 < got.sum() < 7 and len(alone) < 20
