"""Rows with null and repeated ids are told apart by their texts, and equal rows by occurrence."""

from __future__ import annotations

from collections import Counter

from timberline.llm import line_dedup, ngram_join

from . import plain

LINE = "some line of plain words that comes again in other rows"
ROWS = [
    (None, f"{LINE}\nalpha beta gamma delta one"), (None, f"quite other words stand at first here now\n{LINE}"),
    (7, "zebra yak xerus wolf vole\nunicorn tapir snake rat quail"), (7, "apple banana cherry damson elder\nfig grape hazel iris juniper"),
    (8, "equal rows lose all but one copy\n\nof every line with a word"), (8, "equal rows lose all but one copy\n\nof every line with a word"),
]


def test_lines_go_from_the_row_that_has_them(spark):
    docs = plain.table(spark, [(i, t, None) for i, t in ROWS]).repartition(3)
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup(docs).collect())
    assert sum(LINE in t for _, t in got.elements()) == 1
    assert {"alpha beta gamma delta one", "quite other words stand at first here now"} <= {x for _, t in got for x in t.split("\n")}
    assert got[(8, ROWS[4][1])] == 1 and got[(8, "")] == 1
    assert got[ROWS[2]] == got[ROWS[3]] == 1 and got.total() == len(ROWS)
    report = [r for r in line_dedup.report(docs).collect() if r.doc_id == 8]
    assert sorted((r.n_lines, r.n_removed, r.kept_sha256) for r in report) == sorted([(3, 0, plain.sha(ROWS[4][1].encode())), (3, 2, plain.sha(b""))])


def test_one_row_of_a_group_stays(spark):
    a, b, c = "one two three four five six seven", "lone words that nobody has but this row", "third text with its very own set of words"
    rows = [(None, a), (None, a), (None, b), (3, a), (4, c), (4, c), (5, c), (5, "again a unique text of several words here"), (None, None), (None, None)]
    docs = plain.table(spark, [(i, t, None) for i, t in rows]).repartition(3)
    got = Counter((r.doc_id, r.text) for r in ngram_join.keep_first(docs).collect())
    assert got == Counter({(None, a): 1, (None, b): 1, (4, c): 1, (5, rows[7][1]): 1, (None, None): 2})
