"""Every registered query against its oracle SQL on the smallest given tables."""

from pathlib import Path

import pytest
from check_oracles import connect, difference, type_difference

import __spark_entry__ as entry
from trovelake.plans import catalog, oracles

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracles.oracle_sql())
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    result, sql = entry.queries()[name](spark, SF_DIR), entry.oracle_sql()[name]
    got = result.toPandas()
    assert len(got)
    assert type_difference(result.schema, duck, sql) is None
    assert difference(got, duck.execute(sql).df()) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
