import pytest

import helixframe.plans.files  # noqa: F401  registers its queries
from helixframe.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(name, same_as_sql):
    assert same_as_sql(QUERIES[name], ORACLE_SQL[name]) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
