import pytest

from stemma.plans.registry import every
from tests.compare import connect, differs


#: The smallest tables leave some queries without rows.
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(every()))
def test_query_equals_its_sql(spark, duck, name):
    assert differs(spark, every()[name], FOLDER, duck) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_covers_name_only_what_is_there():
    missing = {"WN04", "SNK07", "VS05", "VS07"}
    assert not {q.name: q.covers for q in every().values() if missing & set(q.covers)}
