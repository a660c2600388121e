"""Every query with SQL gives the rows that the SQL gives."""

from __future__ import annotations

import pytest

from timberline import queries

from .compare import agree


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_agrees_with_sql(spark, sf, name):
    agree(spark, queries.QUERIES[name], queries.ORACLES[name], sf)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
