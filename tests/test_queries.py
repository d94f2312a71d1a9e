import pytest
from tests.support import DATA, same

import __spark_entry__ as entry
from emrecon.jobs import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    same(entry.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["c", "x"]
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
