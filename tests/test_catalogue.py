"""Every query of the graph engine equals its SQL, on whole small tables."""

from __future__ import annotations

import pytest

from weft import catalogue_queries

from .conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue_queries.queries()))
def test_query(spark, same_rows, name):
    same_rows(catalogue_queries.queries()[name](spark, SF), catalogue_queries.oracle_sql()[name])
