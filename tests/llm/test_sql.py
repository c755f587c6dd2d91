"""Every query of the subpackage that has SQL against DuckDB."""

import pytest

from corpusloom.llm.queries import QUERIES
from corpusloom.llm.sql import SQL
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert oracle.compare(spark, duck, name, QUERIES[name], SQL[name], SF) == ""
