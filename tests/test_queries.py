import pytest

from ledgerline.plans import catalogue
from tests.oracle import same

MAY_BE_EMPTY = set()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, name):
    n = same(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], sf)
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
