import pytest

from keystrata.plans import catalogue, persisted
from tests.oracle import compare, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_its_sql(spark, name):
    compare(catalogue.QUERIES[name](spark, SF), views(SF), catalogue.ORACLES[name])


@pytest.mark.parametrize("name", persisted.QUERIES)
def test_query_of_a_written_dataset_equals_its_sql(spark, name):
    compare(persisted.QUERIES[name](spark, SF), views(SF), persisted.ORACLES[name])


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    for held in (catalogue, persisted):
        assert set(held.QUERIES) == set(held.ORACLES) and set(held.QUERIES) <= set(e.queries()) and set(held.ORACLES) <= set(e.oracle_sql())
