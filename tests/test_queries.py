import os

import pytest
from oracle import DATA, compare

import __spark_entry__ as entry
from siltstone import plans


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    compare(spark, plans.QUERIES[name], plans.ORACLE_SQL[name])


def test_every_query_of_the_engine_has_a_twin():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
