import pytest

from stemma.llm import queries
from stemma.plans.registry import Query
from tests.compare import connect, differs


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert differs(spark, Query(name, (), queries.queries()[name], queries.oracle_sql()[name]), folder, connect(folder)) is None
