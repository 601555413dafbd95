import pytest
from oracle import compare, connect

from tallyloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    compare(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])
