"""Standardising deals out no rows, and tells what it did without meeting the rows again."""

from __future__ import annotations

from timberline import change_queries, queries
from timberline.operators import changes
from timberline.operators.writes import standardized

from .compare import agree
from .test_changes import book


def test_rows_are_not_dealt_out_by_id(spark, sf):
    plan = change_queries.standardize_changes(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and plan.count("Relation [") <= 12


def test_differences_side_by_side_are_those_of_a_join(spark):
    rows = book(
        spark,
        [
            (1, "MWS", "SHAKER TABLES", "T-1", "Table", 100.0, 2.7, "Oak", None), (2, "Millers Woodshop", "Chairs", "C-1", "Chair", None, 2.7, "Oak", None),
            (3, "Nobody", None, "C-2", "Chair", 50.0, None, None, "x"), (4, "FN Chair", "price", "C-3", "Chair", 50.004, 2.7, "Oak", " "),
            (5, None, "Chairs", None, "AB-12", 5.0, 2.7, "12 x 14", None), (6, "Nobody", "Chairs", "C-9", "New Items", 5.0, 2.7, "col_3", None),
            (None, "Nobody", "Chairs", "C-2", "Chair", 50.0, 2.7, "Oak", None), (None, "Nobody", "Chairs", "C-2", "Chair", None, 2.7, "Oak", None), (7, "Nobody", "Chairs", "C-2", "Chair", 50.0, 2.7, "Oak", None),
        ],
    )
    settings = spark.createDataFrame([("mws", 2.5)], "name string, multiplier double")
    said = lambda d: sorted(((r.id, r.status, tuple(r.fields)) for r in d.collect()), key=repr)
    clean = standardized(rows)
    got = said(changes.standardized_in_place(rows, settings)[2])
    assert got == said(changes.differences(rows, clean))
    assert {s for _, s, _ in got} == {"changed", "dropped", "added"}
    # a vendor's own collection stands where none is left
    assert {r.id: r.collection for r in clean.collect() if r.id in (3, 4)} == {3: None, 4: "Seating"}


def test_moved_rows_and_standardised_ones_agree_with_sql(spark, sf):
    for name in ("catalog_differences", "standardize_changes"):
        assert agree(spark, queries.QUERIES[name], queries.ORACLES[name], sf)
