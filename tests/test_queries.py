"""Every query against its SQL on the smallest tables; those without SQL give rows."""

import pytest

from seamline.plans import catalogue
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    compare(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], spark, SF, con)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
