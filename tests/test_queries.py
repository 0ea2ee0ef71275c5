import pytest

from lodestar.plans.registry import ORACLES, QUERIES
from tests.comparing import duck, rows_of_duck, rows_of_spark


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert rows_of_spark(QUERIES[name](spark, sf_dir)) == rows_of_duck(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows[0]["n"] > 0 and set(entry.oracle_sql()) <= set(entry.queries())
