"""Work that grows with the tables: parts that a task sorts, and what is done a row."""

from __future__ import annotations

import re

import pytest

from timberline import queries
from timberline.operators import search
from timberline.plans import catalog

DEALT = ["dup_groups", "cleanup_keep_newest", "cleanup_counts", "exact_dup_keep_max_id", "exact_duplicate_groups", "best_matrix_rows", "pivot_by_species"]


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", DEALT)
def test_parts_grow_with_the_lines(spark, sf, name, monkeypatch):
    """Twice as many parts where a task takes half the rows, and no other shuffle of the catalog's rows after the last."""
    monkeypatch.setattr(catalog, "TASK_ROWS", 100)
    n = catalog.parts_of(spark, sf)
    frame = queries.QUERIES[name](spark, sf)
    assert n == 60 and plan(frame).count(f", {n}") >= 2
    physical = frame._jdf.queryExecution().executedPlan().toString()
    top = physical[: physical.index(f"{n}), REPARTITION_BY_NUM")]
    # a hash shuffle after the last dealing would be one of Spark's own count
    assert not re.search(r"Exchange hashpartitioning\(.*ENSURE_REQUIREMENTS", top)


@pytest.mark.parametrize("name", ["option_facet", "species_facet"])
def test_patterns_meet_distinct_labels_only(spark, sf, name):
    text = plan(queries.QUERIES[name](spark, sf))
    a_row = text[text.rindex("Aggregate", 0, text.index("Join")) :]
    assert not re.search("RLIKE|regexp_replace", a_row)


def test_words_are_not_looked_for_in_prices(spark):
    cells = "id long, part_number string, base_price double, adjusted_price double"
    rows = catalog.conform(spark.createDataFrame([(1, "ring", 1250.0, 12.5), (2, None, -3.0, None), (3, "1250", None, None)], cells))
    assert "decimal" not in plan(rows.filter(search.holds("ring")))
    for term, ids in {"ring": [1], "1250": [1, 3], "12.5": [1], "250.0": [1], "-3": [2], ".": [1, 2], "1,250": []}.items():
        assert sorted(r.id for r in rows.filter(search.holds(term)).collect()) == ids, term


@pytest.mark.parametrize("name", ["best_table", "best_reading", "page_readings", "item_blocks", "inline_prices", "price_lines", "column_streams"])
def test_no_task_orders_a_whole_file(spark, sf, name, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_ROWS", 20)
    text = plan(queries.QUERIES[name](spark, sf))
    assert not re.search(r"windowspecdefinition\((file|p_brand)#\d+, ((table|p_type|sheet)#\d+, )?(at|row|p_partkey|k)#\d+L? ASC", text)
    rows = {"column_streams": 9, "best_table": 1}.get(name, 4)
    assert f", {catalog.parts_of(spark, sf, 'part', rows)}" in text


@pytest.mark.parametrize("name", ["two_row_headers", "header_places"])
def test_sheets_stay_in_the_parts_they_are_dealt_to(spark, sf, name, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_ROWS", 20)
    frame, n = queries.QUERIES[name](spark, sf), catalog.parts_of(spark, sf, "part", 3)
    assert not re.search(r"windowspecdefinition\(p_brand#\d+, p_partkey#\d+L? ASC", plan(frame))
    assert plan(frame).count("RepartitionByExpression [file") and f", {n}" in plan(frame)
    # no shuffle of cells by a number of Spark's own
    physical = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(file#\d+, sheet#\d+, (8|200)\)|Exchange hashpartitioning\(file#\d+, sheet#\d+, [a-z]+#", physical)
