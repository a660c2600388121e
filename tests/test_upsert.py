"""Upserts meet only the last row of a configuration; all other rows stay as they are."""

from __future__ import annotations

from timberline.operators import writes
from timberline.plans.catalog import conform

ROW = "id long, vendor string, part_number string, description string, base_price double"


def test_old_and_nameless_rows_stay(spark):
    old = conform(spark.createDataFrame([(1, "V", "a", "x", 1.0), (2, "v", "A", "y", 2.0), (3, None, None, "loose", 3.0), (4, "V", "b", None, 4.0), (5, None, "", "loose", 5.0)], ROW))
    new = conform(spark.createDataFrame([(9, "V", "a", None, 9.0), (10, "V", "a", "z", 10.0), (11, "V", "c", None, 11.0), (12, None, None, "new", 12.0), (13, None, None, None, None)], ROW))
    got = sorted((r.id, r.base_price, r.description, r.change) for r in writes.upsert(old, new).collect())
    assert got == [(1, 1.0, "x", "kept"), (2, 9.0, "y", "updated"), (3, 3.0, "loose", "kept"), (4, 4.0, None, "kept"), (5, 5.0, "loose", "kept"), (11, 11.0, None, "inserted"), (12, 12.0, "new", "inserted")]


def test_no_null_key_is_joined(spark):
    old = conform(spark.createDataFrame([(1, "V", "a", "x", 1.0)], ROW))
    plan = writes.upsert(old, old)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and plan.count("Join ") == 1
