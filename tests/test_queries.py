"""Every registered query against its DuckDB form; those without one must run and have rows."""

import pytest

from dotspark import plans
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.available(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, name):
    oracle.compare(spark, plans.QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, oracle.SF).count() > 0
