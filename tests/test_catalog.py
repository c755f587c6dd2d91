"""Every registered query with SQL against DuckDB on the smallest table."""

import pytest

from corpusloom import catalog, catalog_archived, catalog_reports, catalog_runs  # noqa: F401
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert oracle.compare(spark, duck, name, catalog.QUERIES[name], catalog.SQL[name], SF) == ""
