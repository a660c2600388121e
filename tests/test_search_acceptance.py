"""How a search text is read, and which rows it finds: every form that users type, as parsed tree and by result."""

from __future__ import annotations

import pytest

from timberline.operators import search
from timberline.plans.catalog import SEARCHED


def term(text: str) -> tuple:
    return ("term", text)


OAK, MAPLE, CHAIR, DUST = term("oak"), term("maple"), term("chair"), term("dust")

READ = [
    ("oak nightstand", ("and", OAK, term("nightstand"))),
    ("oak AND nightstand", ("and", OAK, term("nightstand"))),
    ("oak OR maple chair", ("or", OAK, ("and", MAPLE, CHAIR))),
    ("oak or maple chair", ("or", OAK, ("and", MAPLE, CHAIR))),
    ("(oak OR maple) chair", ("and", ("or", OAK, MAPLE), CHAIR)),
    ("oak | maple", ("or", OAK, MAPLE)),
    ("oak|maple", ("or", OAK, MAPLE)),
    ("oak ∨ maple", ("or", OAK, MAPLE)),
    ("oak∨maple", term("oak∨maple")),
    ("-dust", ("not", DUST)),
    ("NOT dust", ("not", DUST)),
    ("(oak -dust)", ("and", OAK, ("not", DUST))),
    ("GO-AVNNS", term("GO-AVNNS")),
    ("- dust", ("and", term("-"), DUST)),
    ("Miller's", ("and", term("Miller"), term("s"))),
    ('"bar stool', term("bar stool")),
    ('"bar stool" oak', ("and", term("bar stool"), OAK)),
    ("'bar stool'", term("bar stool")),
    ('""', term("")),
    ("AND OR NOT", None),
    ("()", None),
    ("oak OR", OAK),
    ("OR oak", OAK),
    ("(oak", OAK),
    ("oak)", OAK),
    ("NOT oak maple", ("and", ("not", OAK), MAPLE)),
    ("NOT NOT oak", ("not", ("not", OAK))),
    ("oak maple OR chair dust", ("or", ("and", OAK, MAPLE), ("and", CHAIR, DUST))),
]


@pytest.mark.parametrize(("text", "tree"), READ)
def test_read(text, tree):
    assert search.parse(text).tree == tree


def test_negated_terms_count_for_the_order():
    assert search.parse("oak -dust").terms == ["oak", "dust"]


ROWS = [
    (1, "Oak nightstand", "NS-1", 100.0),
    (2, "Maple chair", "CH-1", 1250.0),
    (3, "Oak chair with dust cover", "CH-2-DC", 80.0),
    (4, "Miller's bar stool", "GO-AVNNS", 12500000.0),
    (5, "Maple stool - bar height", "ST-9", 60.0),
]

FOUND = [
    ("oak nightstand", {1}),
    ("OAK", {1, 3}),
    ("oak OR maple chair", {1, 2, 3}),
    ("(oak | maple) chair", {2, 3}),
    ("-dust", {1, 2, 4, 5}),
    ("oak -dust", {1}),
    ("- bar", {4, 5}),
    ("GO-AVNNS", {4}),
    ("Miller's", {4}),
    ('"bar stool"', {4}),
    ("bar stool", {4, 5}),
    ('"bar stool', {4}),
    ('""', {1, 2, 3, 4, 5}),
    ("AND OR NOT", set()),
    ("oak OR", {1, 3}),
    ("(oak", {1, 3}),
    ("oak)", {1, 3}),
    ("NOT oak chair", {2}),
    ("1250", {2, 4}),
    ("12500000.0", {4}),
    ("", {1, 2, 3, 4, 5}),
]


@pytest.fixture(scope="module")
def rows(spark):
    texts = dict.fromkeys([*SEARCHED, *search.BROWSE, "finish_state", "line_kind", "option_key", "species", "collection"])
    names = [c for c in texts if c not in ("id", "description", "part_number", "species_tier")]
    kinds = ", ".join(f"{c} string" for c in names)
    data = [(i, d, p, price, price, 0, *[None] * len(names)) for i, d, p, price in ROWS]
    return spark.createDataFrame(data, f"id long, description string, part_number string, base_price double, adjusted_price double, species_tier int, {kinds}").cache()


@pytest.mark.parametrize(("text", "ids"), FOUND)
def test_found(rows, text, ids):
    assert {r["id"] for r in search.search(rows, text).select("id").collect()} == ids


def test_order_uses_the_longest_term_and_the_first_of_equals(rows):
    # "chair" ranks both alike, then a dust cover comes last
    assert [r["id"] for r in search.search(rows, "chair").collect()] == [2, 3]
    # a part number that starts with the term comes before a description that holds it
    assert [r["id"] for r in search.search(rows, "st").collect()][:1] == [5]


def test_nothing_without_words_or_vendor(rows):
    assert search.guarded(rows, " ").count() == 0
    assert search.guarded(rows, "", vendor="All").count() == 0
    assert search.guarded(rows, "oak").count() == 2
