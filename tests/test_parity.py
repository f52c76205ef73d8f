"""Every query of the reference's operators against its SQL twin, and those without one for rows."""

import pytest

from evalgrid import plans
from evalgrid.plans import catalog
from tests.parity import DATA, check, connect

QUERIES = catalog.load()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    check(spark, con, QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - plans.ORACLES.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
