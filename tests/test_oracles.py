"""Every registered query of the memory engine against its SQL."""

import pytest

from compare import same
from factloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), sf, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
